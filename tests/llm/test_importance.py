import hashlib
import math
import re
import zlib
from collections import Counter

import pandas as pd
import pytest

from llm_cases import FOLDER, needs_data
from spelltally.llm import importance


def plain_features(text):
    words = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().lower())
    runs = [b" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]
    return len(words), [zlib.crc32(run) % 10000 for run in runs]


def plain(docs, target, percent=5, least=20):
    made = [(i, *plain_features(text)) for i, text in docs]
    s, t = Counter(b for _, _, f in made for b in f), Counter(b for text in target for b in plain_features(text)[1])
    all_s, all_t = sum(s.values()) + 10000, sum(t.values()) + 10000
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * all_s / ((s[b] + 1) * all_t))) for b in s}
    rows = []
    for i, words, f in made:
        h = int(hashlib.sha256(f"42:{i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        rows.append((i, words, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    enough = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0]))
    rank = {r[0]: n + 1 for n, r in enumerate(enough[: percent * len(enough) // 100])}
    return sorted((i, f, w, s, rank.get(i)) for i, _, f, w, s in rows)


def rows_of(frame):
    rows = frame.select("doc_id", "n_features", "weight", "score", "rank").collect()
    return sorted((tuple(r) for r in rows), key=lambda r: (r[0] is not None, r[0]))


@needs_data
def test_query_against_plain_counts(provided, documents):
    made = provided("op11_target_resampling")
    target = pd.read_parquet(f"{FOLDER}/benchmark.parquet").text
    rows = [
        (int(r.doc_id), int(r.n_features), int(r.weight), int(r.score), None if pd.isna(r.rank) else int(r.rank))
        for r in made.rename(columns={"rank": "rank"}).itertuples(index=False)
    ]
    assert sorted(rows, key=lambda r: r[0]) == plain(zip(documents.doc_id, documents.text), target)


@pytest.mark.parametrize("text", ["", " .. ", "one", "A b", "x-1 Ünï été__ 9", "a  b\nc.d,e", "ſK k"])
def test_spans(text):
    flat = importance.collapsed(text.encode())
    words = flat.split(b" ") if flat else []
    assert [flat[a:b] for a, b in importance.ngram_spans(flat)] == [
        b" ".join(words[i : i + n]) for i in range(len(words)) for n in (1, 2, 3) if i + n <= len(words)
    ]
    number, buckets = importance.feature_buckets(text.encode(), importance.ngram_pattern(), 10000)
    assert (number, sorted(buckets.tolist())) == (plain_features(text)[0], sorted(plain_features(text)[1]))


def test_many_ranges_and_ties(spark):
    docs = [(i, " ".join(f"w{(i // 3 + k) % 40}" for k in range(20 + i % 3))) for i in range(300)]
    target = [("w1 w2 w3 w4",), ("w5",)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(6)
    made = importance.scored(frame, spark.createDataFrame(target, "text string"), percent=30)
    assert rows_of(made) == plain(docs, [t for t, in target], percent=30)
    same = frame.unionByName(frame)
    ranks = [r["rank"] for r in importance.scored(same, spark.createDataFrame(target, "text string"), percent=30).collect()]
    assert sorted(r for r in ranks if r is not None) == list(range(1, 181))


def test_odd_documents(spark, odd):
    target = spark.createDataFrame([(None, "q"), ("", "q"), ("the quick brown fox", "q")], "text string, doc_id string")
    made = {r["doc_id"]: r for r in importance.scored(odd, target, percent=100, least_words=1).collect()}
    assert made[2]["n_features"] == made[3]["n_features"] == made[5]["weight"] == 0 and made[2]["rank"] is None
    assert made[4]["n_features"] == 3 * 60_000 - 3 and made[None]["rank"] is not None
    assert made[6]["weight"] == made[1]["weight"]
    kept = importance.resampled(odd, target, percent=100, least_words=1)
    assert kept.columns == odd.columns and kept.count() == 5


def test_no_documents_or_no_target(spark, odd, empty):
    none = importance.scored(empty, odd)
    assert none.count() == 0 and none.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank", "text_hash"]
    assert importance.scored(odd, empty).count() == odd.count()
