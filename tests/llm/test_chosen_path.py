import numpy as np
import pandas as pd
import pytest

from llm_cases import ODD, needs_data
from spelltally.llm import chosen_path, common, overlap


def plain_set(text, size=5):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def plain_components(texts, numerator=85, denominator=100):
    """For each text the place of the first it can reach; texts without words reach none."""
    sets, label, seen = [plain_set(t) for t in texts], list(range(len(texts))), {}
    holders = {}
    for i, s in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(i)
    for i, a in enumerate(sets):
        near = {j for x in a for j in holders[x] if j < i}
        for j in near:
            shared = len(a & sets[j])
            if label[i] != label[j] and denominator * shared >= numerator * (len(a) + len(sets[j]) - shared):
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    return label


def components_of(spark, texts):
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(7)
    rows = sorted(chosen_path.joined(frame).collect(), key=lambda r: r["doc_id"])
    assert [r["n_shingles"] for r in rows] == [len(plain_set(t)) for t in texts]
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows)
    return [r["component_id"] for r in rows]


@needs_data
def test_query_against_brute_force(provided, documents):
    made = provided("op13_set_near_copies").sort_values("doc_id", ignore_index=True)
    assert list(made["doc_id"]) == list(documents["doc_id"])
    wanted = [documents["doc_id"][i] for i in plain_components(documents["text"])]
    assert list(made["component_id"]) == wanted and len(set(wanted)) < len(wanted)


def edited(words, places, rng):
    other = list(words)
    for place in places:
        other[place] = f"x{rng.integers(1 << 40)}"
    return other


def test_every_size_against_brute_force(spark):
    """Texts of 1 to 500 shingles, cut short or edited, many right at the bound."""
    rng, texts = np.random.default_rng(7), []
    for size in [*range(1, 26), 40, 60, 100, 200, 500]:
        for _ in range(4):
            words = [f"w{i}" for i in rng.integers(0, 1 << 30, size=size + 4)]
            texts.append(" ".join(words))
            for cut in (int(size * 0.15), int(size * 0.15) + 1):
                texts.append(" ".join(words[: len(words) - cut]))
            if size > 30:
                for edits in (size // 70, size // 60, size // 50):
                    texts.append(" ".join(edited(words, rng.choice(size, edits, replace=False), rng)))
    rng.shuffle(texts)
    assert components_of(spark, texts) == plain_components(texts)


def test_a_mass_of_copies_and_a_common_passage(spark, monkeypatch):
    """Nodes far above the limit: one group of 700 edited copies, and a passage in 600 other texts."""
    monkeypatch.setattr(overlap, "LIMIT", 128)
    rng = np.random.default_rng(11)
    base = [f"b{i}" for i in range(150)]
    texts = [" ".join(edited(base, rng.choice(150, rng.integers(0, 8), replace=False), rng)) for _ in range(700)]
    passage = [f"p{i}" for i in range(60)]
    texts += [" ".join([*passage, *(f"q{i}" for i in rng.integers(0, 1 << 30, size=rng.integers(10, 60)))]) for _ in range(600)]
    assert len(texts) > 8 * overlap.LIMIT
    assert components_of(spark, texts) == plain_components(texts)


def test_nodes_deal_pairs_once_at_least(spark, monkeypatch):
    """Chunks of a node that stays large meet each other; every pair of members shares a node from unlike sides."""
    monkeypatch.setattr(overlap, "LIMIT", 10)
    rows = spark.createDataFrame([(1, 0, code, code) for code in range(57)], "node long, at int, code long, label long")
    again = lambda large: large.select("node", "at", "code", "label")
    members = overlap.dealt(rows, again, 3, True).toPandas()
    met = set()
    for _, node in members.groupby("node"):
        for x in node.itertuples():
            met |= {(x.code, y.code) for y in node.itertuples() if x.code < y.code and (x.side == 2 or x.side != y.side)}
    assert met == {(a, b) for a in range(57) for b in range(a + 1, 57)}


def test_recall_at_the_bound():
    """Simulated trees against the computed chance."""
    rng, hits = np.random.default_rng(2), 0
    for _ in range(4000):
        alive = 1
        for level in range(4):
            picks = 1 if not level else 1 + (rng.random(alive) < 1 / 0.85 - 1)
            alive = rng.binomial(np.sum(picks), 0.85)
            if not alive:
                break
        hits += alive > 0
    assert abs(hits / 4000 - chosen_path.survival(0.85, 4)) < 0.03
    assert chosen_path.recall(0.85) > 0.999


@pytest.mark.parametrize("shingles", [1, 6, 300, 9000])
def test_tokens_estimate_likeness(shingles):
    rng = np.random.default_rng(shingles)
    functions, same = chosen_path.token_functions(), []
    for _ in range(60):
        hashes = rng.integers(0, 1 << 64, size=shingles, dtype=np.uint64)
        more = rng.integers(0, 1 << 64, size=max(1, shingles // 6), dtype=np.uint64)
        a, b = chosen_path.minwise(hashes, functions), chosen_path.minwise(np.r_[hashes, more], functions)
        same.append(np.mean(a == b) - shingles / (shingles + len(more)))
    assert abs(np.mean(same)) < 0.03


def test_odd_documents(spark, odd, empty):
    rows = chosen_path.joined(odd).toPandas()
    assert len(rows) == len(ODD) and list(rows.columns) == ["doc_id", "n_shingles", "component_id", "kept"]
    by_id = rows.set_index("doc_id")
    assert (by_id.loc[[2, 3, 5], "n_shingles"] == 0).all() and (by_id.loc[[2, 3, 5], "kept"]).all()
    assert by_id.loc[6, "component_id"] == 1 and not by_id.loc[6, "kept"]
    nulls = rows[rows["doc_id"].isna()]
    assert len(nulls) == 1 and nulls["component_id"].isna().all() and nulls["kept"].all()
    assert by_id.loc[4, "n_shingles"] == 1
    assert chosen_path.joined(empty).count() == 0
    big = spark.createDataFrame([(2**53 + 1, "a b c d e f"), (None, "A b c d e  f"), (2**53 + 3, "z")], "doc_id long, text string")
    assert {(r["doc_id"], r["component_id"]) for r in chosen_path.joined(big).collect()} == {
        (2**53 + 1, 2**53 + 1), (None, 2**53 + 1), (2**53 + 3, 2**53 + 3)
    }


def test_whole_nodes_across_batches():
    frame = pd.DataFrame({"node": [1, 1, 1, 2, 2, 3, 4, 4, 4, 4], "x": range(10)})
    for size in (1, 2, 3, 10):
        batches = (frame.iloc[i : i + size].reset_index(drop=True) for i in range(0, 10, size))
        made = list(common.whole_nodes(batches))
        assert pd.concat(made)["x"].tolist() == list(range(10))
        nodes = [set(m["node"]) for m in made]
        assert sum(map(len, nodes)) == 4
