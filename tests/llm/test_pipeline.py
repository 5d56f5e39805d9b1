"""The corpus pipeline's stages against brute force, each on its own input."""

import corpus_pipeline
import pytest
from compare import difference, engine
from pyspark.sql import functions as F

from leakscope.llm import toxicity
from leakscope.llm.queries import QUERIES

from .conftest import roots, shingles, similar
from .test_text import brute_leaks
from .test_tokens import checked


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "near_duplicates", "decontamination", "packing"]

    clean = stages["toxicity"](spark, docs, sf)
    model = toxicity.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    bad = {r["doc_id"] for r in toxicity.toxicity(docs, model).where("predicted = 1").collect()}
    rows = docs.collect()
    left = [r for r in rows if r["doc_id"] not in bad]
    assert bad and sorted(clean.collect()) == sorted(left)

    single = stages["near_duplicates"](spark, clean, sf)
    sets = {r["doc_id"]: shingles(r["text"]) for r in left}
    root = roots(similar(sets), sets)
    left = [r for r in left if root[r["doc_id"]] == r["doc_id"]]
    assert sorted(single.collect()) == sorted(left)

    whole = stages["decontamination"](spark, single, sf)
    items = spark.read.parquet(f"{sf}/benchmark.parquet").collect()
    leaks = {d for d, _ in brute_leaks([(r["doc_id"], r["text"]) for r in left],
                                       [(r["item_id"], r["text"]) for r in items])}
    left = [r for r in left if r["doc_id"] not in leaks]
    assert leaks and sorted(whole.collect()) == sorted(left)

    packed = corpus_pipeline.run(spark, sf).collect()
    _, documents = checked(packed, 2048)
    assert set(documents) == {r["doc_id"] for r in left}


def test_stages_on_odd_rows(spark, odd_docs, no_docs, sf):
    for df in (odd_docs, no_docs):
        now = df.select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"),
                        F.length("text").cast("long").alias("n_chars"))
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, now, sf)
            assert out.columns == now.columns
            if name == "near_duplicates" and df is odd_docs:
                ids = sorted(r["doc_id"] or 0 for r in out.collect())
                assert ids == [0, 0, 1, 3, 4, 5, 6, 8, 10, 12]
            now = out
        assert corpus_pipeline.pack(spark, now, sf).count() >= now.count()


@pytest.mark.parametrize("name", [n for n, (_, sql) in QUERIES.items() if sql])
def test_equal_to_sql(spark, name):
    small = "/root/testdata/sf0.001"
    run, sql = QUERIES[name]
    assert difference(run(spark, small), engine(small), sql) is None
