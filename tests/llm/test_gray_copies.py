import numpy as np
import pytest
from llm_cases import FOLDER, ODD, needs_data
from test_chosen_path import edited, plain_components

from spelltally.llm import near_copies


def kept_of(spark, texts):
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(7)
    return sorted(r["doc_id"] for r in near_copies.one_of_each(frame).collect())


@needs_data
def test_provided_documents_against_brute_force(spark, documents):
    texts = list(documents["text"])
    # Texts without words are one component here.
    empty = [i for i, t in enumerate(texts) if not (t or "").split()]
    label = [empty[0] if i in empty else c for i, c in enumerate(plain_components(texts, 4, 5))]
    kept = near_copies.one_of_each(spark.read.parquet(f"{FOLDER}/documents.parquet"))
    assert sorted(r["doc_id"] for r in kept.select("doc_id").collect()) == [documents["doc_id"][i] for i in sorted(set(label))]


def test_small_sets_are_all_found(spark):
    """1 to 20 shingles, equal and unequal sizes, right at 0.8 and just below."""
    rng, texts = np.random.default_rng(9), []
    for size in range(1, 21):
        for _ in range(25):
            words = [f"w{i}" for i in rng.integers(0, 1 << 30, size=size + 4)]
            texts.append(" ".join(words))
            more = [f"v{i}" for i in rng.integers(0, 1 << 30, size=size // 4 + 1)]
            texts.append(" ".join(words + more[: size // 4]))
            texts.append(" ".join(words + more))
    rng.shuffle(texts)
    label = plain_components(texts, 4, 5)
    assert kept_of(spark, texts) == sorted(set(label)) and len(set(label)) < len(texts)


def test_large_sets_against_brute_force(spark):
    rng, texts = np.random.default_rng(4), []
    for size in (25, 60, 150, 500):
        for _ in range(30):
            words = [f"w{i}" for i in rng.integers(0, 1 << 30, size=size + 4)]
            texts.append(" ".join(words))
            for edits in (size // 70, size // 55, size // 48, size // 30):
                texts.append(" ".join(edited(words, rng.choice(size, edits, replace=False), rng)))
            texts.append(" ".join(words[: int(size * 0.82) + 4]))
    label = set(plain_components(texts, 4, 5))
    found = set(kept_of(spark, texts))
    assert label <= found and len(found - label) <= 2


def test_a_mass_of_copies(spark, monkeypatch):
    """One group of 900 edited copies, in nodes that must be split, and what it links to."""
    monkeypatch.setattr(near_copies, "LIMIT", 100)
    rng = np.random.default_rng(3)
    base = [f"b{i}" for i in range(150)]
    texts = [" ".join(edited(base, rng.choice(150, rng.integers(0, 9), replace=False), rng)) for _ in range(900)]
    label = set(plain_components(texts, 4, 5))
    found = set(kept_of(spark, texts))
    assert label <= found and len(found - label) <= 2


@pytest.mark.parametrize("every", [True, False])
def test_split_nodes_miss_no_pair(spark, monkeypatch, every):
    """Pairs of unlike labels meet from unlike sides; rows of the main label are dealt once per chunk of others."""
    monkeypatch.setattr(near_copies, "LIMIT", 32)
    rows = [(7, 0, code, 1 if code % 10 else code) for code in range(1, 2001)] + [(8, 0, code, code) for code in range(5)]
    frame = spark.createDataFrame(rows, "node long, at int, code long, label long")
    members = near_copies.split(frame, every).toPandas()
    assert set(members["code"]) == set(range(2001))
    if not every:
        assert members.groupby("node").size().max() < 120 and len(members) == len(rows)
        return
    met = set()
    for _, node in members.groupby("node"):
        part = list(node.itertuples())
        met |= {(x.code, y.code) for x in part for y in part if x.code < y.code and x.label != y.label and (x.side == 2 or x.side != y.side)}
    wanted = {(a, b) for a in range(1, 2001) for b in range(a + 1, 2001) if not (a % 10 and b % 10)}
    wanted |= {(a, b) for a in range(5) for b in range(a + 1, 5)}
    assert wanted <= met


@pytest.mark.parametrize("number", [2, 9, 70, 500])
def test_gray_pairs_are_all_near_pairs(number):
    rng = np.random.default_rng(number)
    base = rng.integers(0, 1 << 63, size=(max(1, number // 20), 4)).astype(np.uint64)
    words = base[rng.integers(0, len(base), size=number)]
    for row in words:
        for bit in rng.choice(256, rng.integers(0, 60), replace=False):
            row[bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
    label = rng.integers(0, 3, size=number)
    a, b = near_copies.gray_pairs(words, label)
    found = {(min(x, y), max(x, y)) for x, y in zip(a.tolist(), b.tolist())}
    apart = np.bitwise_count(words[:, None] ^ words[None]).sum(axis=2)
    assert found == {(i, j) for i in range(number) for j in range(i + 1, number) if apart[i, j] <= near_copies.WIDE and label[i] != label[j]}


def test_gray_order_is_that_of_the_whole_number():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 1 << 63, size=(300, 2)).astype(np.uint64) * np.uint64(2) + rng.integers(0, 2, size=(300, 2)).astype(np.uint64)

    def rank(row):
        code = int(row[0]) << 64 | int(row[1])
        for shift in (64, 32, 16, 8, 4, 2, 1):
            code ^= code >> shift
        return code

    assert list(near_copies.gray_order(words)) == sorted(range(300), key=lambda i: rank(words[i]))


@pytest.mark.parametrize("codes", [1000, 10**6])
def test_masks_find_pairs_at_the_bound(codes):
    rng, found = np.random.default_rng(codes), 0
    masks = near_copies.masks(codes, 0.8)
    for number in range(400):
        shingles = (27, 90, 450)[number % 3]
        hashes = rng.integers(0, 1 << 64, size=shingles * 10 // 9, dtype=np.uint64)
        a, b = (np.array(near_copies.wide_fingerprint(x)).view(np.uint64) for x in (hashes[:shingles], hashes[-shingles:]))
        apart = a ^ b
        found += bool(((apart & masks) == 0).all(axis=1).any()) and np.bitwise_count(apart).sum() <= near_copies.WIDE
    assert found >= 0.98 * 400


def test_odd_documents(odd, empty):
    kept = near_copies.one_of_each(odd).toPandas()
    assert list(kept.columns) == odd.columns
    assert kept["doc_id"].notna().sum() == len(kept) - 1 and set(kept["doc_id"].dropna()) == {1, 2, 4}
    assert len(kept) < len(ODD) and near_copies.one_of_each(empty).count() == 0
