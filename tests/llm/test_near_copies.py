import numpy as np
import pytest
import xxhash
from llm_cases import ODD

from spelltally.llm import minhash, simhash


def plain_hashes(text, size=4):
    words = text.encode().lower().split()
    if not words:
        return []
    return [xxhash.xxh64_intdigest(b" ".join(words[i : i + size]), 42) for i in range(max(1, len(words) - size + 1))]


def plain_majority(hashes):
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_fingerprint(text, size=4):
    return plain_majority(plain_hashes(text, size))


def plain_components(codes, distance=4):
    label = list(range(len(codes)))
    for i, a in enumerate(codes):
        for j in range(i):
            near = bin(a ^ codes[j]).count("1") <= distance
            if near and label[i] != label[j]:
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    return label


@pytest.mark.parametrize("number", [1, 2, 9, 70, 400])
def test_index_links_what_brute_force_links(number):
    rng = np.random.default_rng(number)
    base = rng.integers(0, 1 << 62, size=max(1, number // 10))
    codes = sorted({int(rng.choice(base)) ^ sum(1 << int(b) for b in rng.choice(62, 3, replace=False)) for _ in range(number)}, key=lambda x: [x := x ^ (x >> s) for s in (32, 16, 8, 4, 2, 1)][-1])
    assert list(simhash.roots(np.array(codes, dtype=np.uint64))) == plain_components(codes)


@pytest.mark.parametrize(("distance", "codes"), [(4, 100), (4, 10**9), (8, 10**6)])
def test_masks_cover_all_near_pairs(distance, codes):
    rng = np.random.default_rng(3)
    masks = simhash.masks(distance, codes)
    for _ in range(300):
        change = sum(1 << int(b) for b in rng.choice(64, distance, replace=False))
        assert any(change & mask == 0 for mask in masks)


def test_near_copies_query(provided, documents):
    rows = provided("op10_near_copies").sort_values("doc_id", ignore_index=True)
    codes = [plain_fingerprint(t) for t in documents["text"]]
    assert list(rows["fingerprint"]) == [f"{c:016x}" for c in codes]
    assert list(rows["component_id"]) == [documents["doc_id"][i] for i in plain_components(codes)]


def test_chains_are_one_component(spark):
    codes = [(1 << i) - 1 for i in range(0, 40, 4)]
    frame = spark.createDataFrame([(c,) for c in codes], "code long")
    found = {r.code: r.root for r in simhash.components(simhash.links(frame)).collect()}
    assert set(found.values()) == {0} and set(found) | {0} == set(codes)


def test_large_nodes_are_dealt_out(spark, monkeypatch):
    """A node with a third of all codes goes to several tasks, with the same links."""
    rng = np.random.default_rng(8)
    near = {0x1234567800000000 | int(x) for x in rng.integers(0, 1 << 14, size=700)}
    far = {int(x) for x in rng.integers(0, 1 << 62, size=1400)}
    codes = sorted(near | far)
    frame = spark.createDataFrame([(c,) for c in codes], "code long")
    plain = [codes[i] for i in plain_components(codes)]
    for most in (1 << 16, 100):
        monkeypatch.setattr(simhash, "LARGEST_NODE", most)
        found = {r.code: r.root for r in simhash.components(simhash.links(frame)).collect()}
        assert [found.get(c, c) for c in codes] == plain
    sizes = simhash.dealt(frame, simhash.masks(4, len(codes))).groupBy("node").count().toPandas()["count"]
    assert sizes.max() < 400


def test_near_odd_rows(odd, empty):
    rows = simhash.near_duplicates(odd).toPandas()
    assert len(rows) == len(ODD)
    assert set(rows["component_id"][rows["code"] == 0]) == {2}
    assert simhash.near_duplicates(empty).count() == 0


def test_fingerprints_query(provided, documents):
    rows = provided("op9_fingerprints").sort_values("doc_id", ignore_index=True)
    texts = list(documents["text"])

    def shingles(text):
        words = text.lower().split()
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}

    import hashlib

    errors = []
    for i, (text, row) in enumerate(zip(texts, rows.itertuples())):
        after, quarter = texts[(i + 1) % len(texts)], len(text) // 4
        edited = text[: len(text) - quarter] + after[:quarter]
        assert row.n_chars == len(text) and row.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        a, b = shingles(text), shingles(edited)
        errors.append(row.near_edited - len(a & b) / len(a | b))
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.05
    same = rows.assign(text=texts).groupby("text")["fingerprint"].nunique()
    assert (same == 1).all()


def test_fingerprints_odd_rows(odd, empty, spark):
    rows = minhash.fingerprinted(odd).toPandas()
    assert len(rows) == len(ODD) and rows["near_next"].between(0, 1).all()
    one = minhash.fingerprinted(spark.createDataFrame([(7, "abcdefgh")], "doc_id long, text string")).first()
    assert one.n_chars == 8 and one.near_next == 1.0
    assert minhash.fingerprinted(empty).count() == 0
