"""Toxicity scores of texts restored through a noisy-channel model.

Disguised words (digits and signs for letters, letters set apart, letters repeated) span a
lattice of readings; a Viterbi search under a character trigram model, counted over all
texts, picks the likeliest. A word of plain letters without doubled ones has one reading and
needs no search. One with doubled letters has two, its spelling and what the search finds; the
second counts unless the spelling itself is found in clean texts rather than in toxic ones.
Restored texts are scored by words and word beginnings that mark toxic texts.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spelltally.llm.common import fold, stored, without

FOLDS, HELD_OUT = 4, 2
# The classifier learns from about so many labels at most, drawn by hash; they are sent to all tasks.
MOST_LABELS = 300_000
TOXIC_FROM = 0.3
# Readings of signs and digits.
READINGS = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "ao", "$": "s", "*": "aeiou", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l",
}
# Costs in natural logarithms: a sign read as a letter, dropped, a repeat dropped, a gap that ends a word.
READ, DROP, REPEAT, BREAK = 1.0, 9.0, 1.0, 6.0
# Letter classes of the character model: 0 ends a word, a-z, and the others by hash.
CLASSES = 64
LM_SMOOTHING = 0.1
EDGE = ".,;:!?'\"()[]{}<>«»¡¿…-–—_*#%&~/\\="
PLAIN = re.compile(r"[^\W\d_]+")
DOUBLED = re.compile(r"(.)\1")
RUNS = re.compile(r"(.)\1+")
# Letters that look like Latin ones, read as those in words that have Latin ones as well. Fixed values.
LOOKALIKE = str.maketrans("аеорсухіѕјԁһкмтвνοαιυρτκ", "aeopcyxisjdhkmtbvoaiuptk")
# Full-width signs and letters are ASCII ones moved by this.
FULL_WIDTH = {code + 0xFEE0: code for code in range(0x21, 0x7F)}
FOREIGN = re.compile("[" + "".join(map(chr, (*LOOKALIKE, *FULL_WIDTH))) + "]")
# A letter or a sign that may stand for one, and what sets letters apart.
SIGN = "(?:[^\\W_]|[" + re.escape("".join(key for key in READINGS if not key.isdigit() and key != "*")) + "])"
APART = r"[\s\-–—_.,;:*~/\\#%&='\"·…]+"
SPACED = re.compile(rf"(?<![^\W_])(?<!{SIGN})(?:{SIGN}{APART}){{2,}}{SIGN}(?!{SIGN})")
# Cheap to look for, and part of all that SPACED matches.
MAYBE_SPACED = re.compile(rf"{APART}{SIGN}{APART}{SIGN}(?!{SIGN})")
EDGE_RUN = re.compile(r"([^\w\s])\1{2,}$")
# Characters counted at once.
PORTION = 1_000_000
# Searched tokens remembered at once.
REMEMBERED = 200_000
# A feature of the toxic vocabulary: least log odds, least log-likelihood ratio. Each takes a number of
# toxic texts, of which ``MOST_LABELS`` bounds the sum; so it bounds what is sent out.
LEAST_WEIGHT, LEAST_RATIO = 2.0, 30.0
PREFIXES = (5, 7)
# Features counted at once by a task, and steps of evidence of the calibration.
COUNTED, STEPS = 300_000, 64


def letter_class(char: str) -> int:
    if "a" <= char <= "z":
        return ord(char) - 96
    return 27 + ord(char) % (CLASSES - 27) if char.isalpha() else 0


_LOW = np.array([letter_class(chr(i).lower()[:1]) for i in range(0x530)], dtype=np.int64)


def trigram_counts(text: str | None) -> np.ndarray:
    """Counts of letter-class trigrams. After a word's end nothing is remembered."""
    points = np.frombuffer((text or "").encode("utf-32-le", "replace"), dtype=np.uint32)
    classes = np.concatenate([[0], _LOW[np.where(points < len(_LOW), points, 32)], [0]])
    older = np.concatenate([[0], classes[:-2]])
    last, now = classes[:-1], classes[1:]
    older = np.where(last == 0, 0, older)
    codes = (older * CLASSES + last) * CLASSES + now
    return np.bincount(codes[(last > 0) | (now > 0)], minlength=CLASSES**3)


def character_costs(docs: DataFrame) -> np.ndarray:
    """Costs of letter-class trigrams over all texts; what reaches the driver has a fixed size."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals = np.zeros(CLASSES**3, dtype=np.int64)
        for batch in batches:
            texts = "\n".join(text for text in batch["text"] if text)
            for start in range(0, len(texts), PORTION):
                totals += trigram_counts(texts[start : start + PORTION])
        code = np.flatnonzero(totals)
        yield pd.DataFrame({"code": code, "number": totals[code]})

    counts = np.zeros(CLASSES**3)
    sums = docs.select("text").mapInPandas(counted, "code long, number long").groupBy("code").agg(F.sum("number"))
    for code, number in sums.collect():
        counts[code] = number
    counts = counts.reshape(CLASSES, CLASSES, CLASSES) + LM_SMOOTHING
    return -np.log(counts / counts.sum(axis=2, keepdims=True))


class Decoder:
    """Restores texts under a table of character costs."""

    def __init__(self, costs: np.ndarray, weights: dict[str, float] | None = None, clean: frozenset[str] = frozenset()):
        """With ``weights`` of features, and spellings that are ``clean``, texts can be scored."""
        self.costs = costs.tolist()
        self.known: dict[str, str] = {}
        self.harmless: set[str] = set()
        self.clean = clean
        self.whole = {f: w for f, w in (weights or {}).items() if not f.endswith("-")}
        self.starts = [(n, {f[:-1]: w for f, w in (weights or {}).items() if f.endswith("-") and len(f) == n + 1}) for n in PREFIXES]
        self.heads = {f[:3] for f in weights or {}}
        # What features look like with every run of a letter as one.
        self.short = {RUNS.sub(r"\1", f) for f in self.whole}
        self.short_starts: dict[int, set[str]] = {}
        for _, starts in self.starts:
            for start in (RUNS.sub(r"\1", f) for f in starts):
                self.short_starts.setdefault(len(start), set()).add(start)

    def strength(self, word: str) -> float:
        """The weight of a word's strongest feature, 0 without one."""
        if word[:3] not in self.heads:
            return 0.0
        weight = self.whole.get(word, 0.0)
        for n, starts in self.starts:
            if len(word) > n:
                weight = max(weight, starts.get(word[:n], 0.0))
        return weight

    def may_mark(self, word: str) -> bool:
        """Whether some reading with fewer repeats could have a feature."""
        short = RUNS.sub(r"\1", word)
        return short in self.short or any(short[:n] in starts for n, starts in self.short_starts.items())

    def marking(self, word: str) -> tuple[float, str]:
        """Weight and text of a restored word's strongest reading: doubled letters have two unless the spelling is clean."""
        best = (self.strength(word), word)
        if DOUBLED.search(word) and PLAIN.fullmatch(word) and word not in self.clean and self.may_mark(word):
            other = self.search(word)
            best = max(best, (self.strength(other), other))
        return best

    def search(self, chars: str, gaps: bool = False) -> str:
        """The likeliest reading; see ``cheapest``."""
        return self.cheapest(chars, gaps)[1]

    def cheapest(self, chars: str, gaps: bool = False) -> tuple[float, str]:
        """Cost and text of the likeliest reading. With ``gaps``, each character stood apart: words may end between any two."""
        best = {(0, 0, ""): (0.0, "")}
        for place, char in enumerate(chars):
            reached: dict[tuple[int, int, str], tuple[float, str]] = {}

            def offer(key: tuple[int, int, str], cost: float, text: str, reached=reached) -> None:
                if key not in reached or cost < reached[key][0]:
                    reached[key] = (cost, text)

            plain = char.isalpha()
            for (older, last, before), (cost, text) in best.items():
                starts = [(older, last, cost, text)]
                if gaps and place and last:
                    starts.append((0, 0, cost + BREAK + self.costs[older][last][0], text + " "))
                for x, y, so_far, read in starts:
                    for letter in (char,) if plain else READINGS.get(char, ""):
                        z = letter_class(letter)
                        step = self.costs[x][y][z] + (0.0 if plain else READ)
                        offer((y if z else 0, z, char), so_far + step, read + letter)
                if char == before:
                    offer((older, last, char), cost + REPEAT, text)
                if not plain:
                    offer((older, last, char), cost + DROP, text)
            best = reached
        return min((cost + self.costs[o][l][0], text) for (o, l, _), (cost, text) in best.items())

    def token(self, token: str) -> str:
        """A token without the signs at its edges, read as a word if it isn't plain."""
        core = token.strip(EDGE)
        foreign = not core.isascii() and FOREIGN.search(core)
        if core.isalpha() and token[0] not in "!(" and not foreign:
            return core
        if foreign:
            token = folded(token)
        core = EDGE_RUN.sub("", token).strip(EDGE)
        sign = token[: len(token) - len(token.lstrip(EDGE))][-1:]
        # A sign before the word that may be its first letter, unless it opens a bracket that is closed.
        if core and sign in READINGS and sign != "*" and any(map(str.isalpha, core)) and not (sign == "(" and ")" in token):
            options = [self.cheapest(core), self.cheapest(sign + core)]
            if min(options)[1] != options[0][1]:
                return min(options)[1]
        if not core or not any(map(str.isalpha, core)):
            return core
        return core if PLAIN.fullmatch(core) else self.search(core)

    def joined(self, run: re.Match[str]) -> str:
        """Letters set apart as words; runs without a letter stay."""
        if not any(map(str.isalpha, run[0])):
            return run[0]
        return self.search(re.sub(APART, "", run[0]), gaps=True)

    def tokens(self, text: str | None) -> list[str]:
        """The lower-cased tokens of a whole text, letters set apart put together."""
        text = (text or "").lower()
        if MAYBE_SPACED.search(text):
            text = SPACED.sub(self.joined, text)
        return text.split()

    def word(self, token: str) -> str:
        word = self.known.get(token)
        if word is None:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            word = self.token(token)
            if DOUBLED.search(word) and PLAIN.fullmatch(word):
                word = self.search(word)
            self.known[token] = word
        return word

    def words(self, text: str | None) -> list[str]:
        """The restored words of a whole text, lower-cased, in order."""
        return [word for word in map(self.word, self.tokens(text)) if word]

    def restored(self, text: str | None) -> list[str]:
        """As ``words``, but spellings with doubled letters stay where their reading marks nothing."""
        return [word for _, word in (self.marking(self.token(token)) for token in self.tokens(text)) if word]

    def spelled(self, text: str | None) -> list[str]:
        """The different words of a text, doubled letters as they are."""
        return sorted({word for word in map(self.token, set(self.tokens(text))) if word})

    def evidence(self, text: str | None) -> float:
        """The sum over different words of the weight of each one's strongest feature."""
        return self.evidence_of(set(self.tokens(text)))

    def evidence_of(self, tokens: set[str]) -> float:
        found = {}
        for token in tokens - self.harmless:
            weight, word = self.marking(self.token(token))
            if weight:
                found[word] = weight
            else:
                if len(self.harmless) >= REMEMBERED:
                    self.harmless.clear()
                self.harmless.add(token)
        return sum(found[word] for word in sorted(found))


def folded(token: str) -> str:
    """Full-width signs as ASCII; letters that only look Latin as Latin where they stand among Latin ones."""
    token = token.translate(FULL_WIDTH)
    return token.translate(LOOKALIKE) if re.search("[a-z]", token) else token


def beginnings(word: str) -> Iterator[str]:
    """The beginnings of a longer word, marked by a hyphen."""
    return (word[:n] + "-" for n in PREFIXES if len(word) > n)


def features(words: list[str]) -> set[str]:
    """The different words of a text and their beginnings."""
    out = set(words)
    for n in PREFIXES:
        out |= {word[:n] + "-" for word in words if len(word) > n}
    return out


def decoded(training: DataFrame, costs: np.ndarray) -> DataFrame:
    """label and ``words`` (see ``Decoder.spelled``) of labelled texts, each decoded once."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        decoder = Decoder(costs)
        for batch in batches:
            yield pd.DataFrame({"label": batch["label"], "words": [decoder.spelled(text) for text in batch["text"]]})

    return stored(training.mapInPandas(read, "label int, words array<string>"), "toxic-words")


def vocabulary(training: DataFrame, costs: np.ndarray) -> tuple[dict[str, float], frozenset[str]]:
    """Weights (log odds) of features of toxic texts, and spellings that are clean though their reading isn't.

    ``training`` is what ``decoded`` gives. Counts cover all of it.
    """

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = (Counter(), Counter())

        def told() -> pd.DataFrame:
            names = list(counts[1].keys() | counts[0].keys())
            rows = {"feature": pd.Series(names, dtype="object"), "toxic": [counts[1][n] for n in names], "clean": [counts[0][n] for n in names]}
            for c in counts:
                c.clear()
            return pd.DataFrame(rows)

        for batch in batches:
            for words, label in zip(batch["words"], batch["label"]):
                counts[int(label)].update(features(words.tolist()))
                counts[int(label)][""] += 1
                if len(counts[0]) + len(counts[1]) > COUNTED:
                    yield told()
        yield told()

    sums = stored(
        training.mapInPandas(counted, "feature string, toxic long, clean long")
        .groupBy("feature")
        .agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        .where(r"toxic > 0 OR feature RLIKE '(.)\\1'"),
        "toxic-features",
    )
    totals = sums.where("feature = ''").first()
    if totals is None or not totals.clean:
        return {}, frozenset()
    toxic, clean = F.col("toxic"), F.col("clean")
    weight = F.log((toxic + 0.5) / (totals.toxic + 1)) - F.log((clean + 0.5) / (totals.clean + 1))
    share = totals.toxic / (totals.toxic + totals.clean)
    expected = (toxic + clean) * share, (toxic + clean) * (1 - share)
    ratio = 2 * (toxic * F.log(toxic / expected[0]) + F.when(clean > 0, clean * F.log(clean / expected[1])).otherwise(0.0))
    chosen = sums.where((F.col("feature") != "") & (toxic > 0) & (weight >= LEAST_WEIGHT) & (ratio >= LEAST_RATIO))
    weights = {r.feature: r.weight for r in chosen.select("feature", weight.alias("weight")).collect()}

    def marked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        decoder = Decoder(costs, weights)
        for batch in batches:
            kept = [word for word in batch["feature"] if decoder.marking(word)[1] != word]
            yield pd.DataFrame({"spelling": pd.Series(kept, dtype="object")})

    # Spellings whose other reading has a feature, and which clean texts hold more than toxic ones.
    doubled = sums.where((weight <= 0) & F.col("feature").rlike(r"(.)\1") & ~F.col("feature").endswith("-"))
    clean_ones = doubled.select("feature").mapInPandas(marked, "spelling string").collect()
    return weights, frozenset(r.spelling for r in clean_ones)


def calibration(training: DataFrame, costs: np.ndarray, weights: dict[str, float], clean: frozenset[str]) -> np.ndarray:
    """The share of toxic texts at each step of evidence, made non-decreasing; 0.5 without labels."""

    def stepped(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        decoder = Decoder(costs, weights, clean)
        for batch in batches:
            steps = [min(STEPS - 1, round(decoder.evidence_of(set(words)))) for words in batch["words"]]
            yield pd.DataFrame({"step": steps, "label": batch["label"]})

    counts = np.zeros((STEPS, 2))
    for step, label, number in training.mapInPandas(stepped, "step int, label int").groupBy("step", "label").count().collect():
        counts[step, label] = number
    blocks: list[list[float]] = []
    for step in range(STEPS):
        # Steps without texts take the share of the step below.
        blocks.append([counts[step, 1], counts[step].sum(), 1])
        while len(blocks) > 1 and (not blocks[-1][1] or blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]):
            top = blocks.pop()
            blocks[-1] = [x + y for x, y in zip(blocks[-1], top)]
    return np.concatenate([np.full(int(width), (ones + 0.5) / (texts + 1)) for ones, texts, width in blocks])


def toxicity(found: float, shares: np.ndarray) -> float:
    """0 to 1: the calibrated share, leaning a little on the evidence itself within a step."""
    share = float(np.interp(found, np.arange(len(shares)), shares))
    return share + (1 - share) * 1e-3 * found / (1 + found)


def score_toxicity(docs: DataFrame, labels: DataFrame, restored: bool = False) -> DataFrame:
    """Add ``held_out``, ``score`` (0 to 1), ``predicted`` and, if asked for, ``restored_text``.

    Needs ``doc_id`` and ``text``; only the text is scored. A null text counts as empty and
    gets a score like any other. Labels other than 0 and 1 are ignored; without toxic
    or without clean ones, scores are near their share. Columns named like a result
    are replaced; repeated rows are scored each; an empty input gives an empty result.
    """
    docs = without(docs, "held_out", "score", "predicted", "restored_text")
    costs = character_costs(docs)
    marks = labels.select("doc_id", F.col("toxic").cast("int").alias("label")).where("label IN (0, 1)")
    share = min(1.0, MOST_LABELS / max(marks.count(), 1))
    marks = marks.where(F.pmod(F.xxhash64("doc_id"), F.lit(10**6)) < int(share * 10**6))
    training = (
        docs.where((fold("doc_id", FOLDS) != HELD_OUT) & F.col("text").isNotNull())
        .select("doc_id", "text")
        .join(F.broadcast(marks), "doc_id")
        .groupBy("text")
        .agg((F.avg("label") >= 0.5).cast("int").alias("label"))
    )
    training = decoded(training, costs)
    weights, clean = vocabulary(training, costs)
    shares = calibration(training, costs, weights, clean)
    sent = docs.sparkSession.sparkContext.broadcast((costs, weights, clean))

    @F.pandas_udf("score double, restored_text string")
    def scored(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        decoder = Decoder(*sent.value)
        for batch in texts:
            yield pd.DataFrame(
                {
                    "score": [toxicity(decoder.evidence(text), shares) for text in batch],
                    "restored_text": [" ".join(decoder.restored(text)) if restored else None for text in batch],
                }
            )

    out = (
        docs.withColumn("_scored", scored("text"))
        .withColumn("held_out", fold("doc_id", FOLDS) == HELD_OUT)
        .withColumn("score", F.col("_scored.score"))
        .withColumn("restored_text", F.col("_scored.restored_text"))
        .withColumn("predicted", (F.col("score") >= TOXIC_FROM).cast("int"))
        .drop("_scored")
    )
    return out if restored else out.drop("restored_text")
