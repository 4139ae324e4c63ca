from llm_cases import FOLDER
from test_chosen_path import plain_components

import corpus_pipeline
from spelltally.llm import mixing, quality
from spelltally.llm.common import stored


def test_stages_keep_columns_and_run(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, numbers = docs.columns, [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, FOLDER)
        assert docs.columns == columns
        numbers.append(docs.count())
    assert numbers[0] >= numbers[1] >= numbers[2] >= numbers[3] > 0
    rows = corpus_pipeline.run(spark, FOLDER).toPandas()
    assert list(rows.columns) == [*columns, "shard", "slot"] and len(rows) == numbers[-1]
    sizes = rows.groupby("shard").size()
    assert sizes.max() - sizes.min() <= 1


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    steps = [docs]
    for _, stage in corpus_pipeline.STAGES:
        steps.append(stored(stage(spark, steps[-1], FOLDER), "test"))
    given, good, single, clean, mixed, dealt = (step.toPandas().sort_values("doc_id", ignore_index=True) for step in steps)

    scores = quality.score_quality(docs, spark.read.parquet(f"{FOLDER}/labels.parquet")).toPandas()
    assert set(good["doc_id"]) == set(scores["doc_id"][scores["predicted"] == 1])

    assert list(single["doc_id"]) == one_of_each(good)

    items = list(spark.read.parquet(f"{FOLDER}/benchmark.parquet").toPandas()["text"])
    holding = {d for d, text in zip(single["doc_id"], single["text"]) if any(item in text for item in items)}
    assert holding and not holding & set(clean["doc_id"])

    wanted = mixing.mix(steps[3]).toPandas()
    copies = {r.doc_id: r.taken // r.size for r in wanted.itertuples() if r.size and r.taken}
    assert mixed[mixed["text"].str.split().str.len() > 0]["doc_id"].value_counts().to_dict() == copies

    assert list(dealt["doc_id"]) == list(mixed["doc_id"])
    for _, part in dealt.groupby("shard"):
        assert sorted(part["slot"]) == list(range(len(part)))


def one_of_each(rows):
    """The smallest id of each component by plain Jaccard of five-word shingles; texts without words are one."""
    texts = list(rows["text"])
    empty = [i for i, t in enumerate(texts) if not (t or "").split()]
    label = [empty[0] if i in empty else c for i, c in enumerate(plain_components(texts, 4, 5))]
    return [rows["doc_id"][i] for i in sorted(set(label))]


def test_stages_of_odd_rows(spark, odd, empty):
    """Nulls, empty and very long texts, repeated rows and extra columns pass through every stage."""
    for given in (odd, empty):
        docs = given
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = stored(stage(spark, docs, FOLDER), "odd")
            assert docs.columns == given.columns, name
        dealt = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER)
        assert dealt.count() == docs.count()
