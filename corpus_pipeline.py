"""Corpus pipeline: toxicity, near duplicates, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir) and returns a table that is written as Parquet and read
again as the next stage's documents. Every stage but the last returns the columns of documents.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leakscope.llm import decontaminate, minhash, pack_tree, tokens, toxicity
from leakscope.llm.common import broadcast_if_small, table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf: str) -> DataFrame:
    """Documents not predicted toxic; the model is fitted on labelled ones among `docs`."""
    return toxicity.without_toxic(docs, toxicity.fit(docs, table(spark, sf, "labels")))


def free(name: str, df: DataFrame) -> str:
    """A column name like `name` that the table does not have."""
    while name in df.columns:
        name += "_"
    return name


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf: str) -> DataFrame:
    """One document of each near-duplicate class: that of the smallest doc_id.

    Documents without an id or without words are kept. Of rows that repeat an id and a text one row
    stays; different texts under one id share its fate.
    """
    classes = written(minhash.near_duplicates(docs), "classes")
    ids = classes.where("n_shingles > 0 and doc_id is not null")
    dropped = ids.groupBy("doc_id").agg(
        F.count("*").alias("rows"),
        F.min(F.col("doc_id") == F.col("component_id")).alias("first"))
    of, first = free("of_id", docs), free("is_first", docs)
    marked = docs.join(
        broadcast_if_small(written(
            dropped.where("not first or rows > 1")
            .select(F.col("doc_id").alias(of), F.col("first").alias(first)), "marked")),
        F.col("doc_id").cast("long") == F.col(of), "left")
    single = marked.where(F.col(of).isNull()).select(*docs.columns)
    repeated = marked.where(F.col(first)).select(*docs.columns).dropDuplicates(["doc_id", "text"])
    return single.unionByName(repeated)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf: str) -> DataFrame:
    """Documents without a benchmark passage."""
    of = free("leaked_id", docs)
    found = decontaminate.leaks(docs, table(spark, sf, "benchmark")).select(
        F.col("doc_id").alias(of)).distinct()
    return docs.join(
        broadcast_if_small(written(found, "leaked")),
        F.col("doc_id").eqNullSafe(F.col(of)), "left_anti")


def pack(spark: SparkSession, docs: DataFrame, sf: str) -> DataFrame:
    """The kept documents packed into sequences of 2048 tokens."""
    return pack_tree.pack(docs, tokens.vocabulary(tokens.WORD_VOCABULARY))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("packing", pack),
]

#: Compression lengths, hashes of shingles and packing have no SQL form: tests hold the stages
#: against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over the table documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
