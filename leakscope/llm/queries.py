"""Registered queries of the corpus operators, with SQL where SQL can express them."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leakscope.llm import (
    chat_format,
    conversation_repair,
    decontaminate,
    html_extract,
    minhash,
    pack_tree,
    polytope,
    shard_shuffle,
    spelling_variants,
    token_count,
    token_output,
    tokens,
    toxicity,
    url_filter,
)
from leakscope.llm.common import table

RULES = [
    ("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"),
    ("block", "net/es/"), ("block", "net/fr/"),
]
SHARDS = 40
COSINE = 0.93
TOKEN_LIMIT = 1024
END_OF_TEXT = 50256


def op1_url_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Every page url judged by the rules, else by the character models."""
    return url_filter.judge(table(spark, sf, "pages"), RULES)


def op2_decontaminate(spark: SparkSession, sf: str) -> DataFrame:
    """Benchmark passages found in documents."""
    return decontaminate.leaks(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


def op3_pack_tree(spark: SparkSession, sf: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens."""
    return pack_tree.pack(
        table(spark, sf, "documents"), tokens.vocabulary(tokens.WORD_VOCABULARY))


def op4_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    """Toxicity of every document."""
    docs = table(spark, sf, "documents")
    return toxicity.toxicity(docs, toxicity.fit(docs, table(spark, sf, "labels")))


def op5_shard_shuffle(spark: SparkSession, sf: str) -> DataFrame:
    """All documents in a uniform order over 40 shards whose counts are at most one apart."""
    out = shard_shuffle.shuffle_into_shards(table(spark, sf, "documents"), SHARDS)
    return out.withColumns({
        "law": F.lit("rows"), "grown_shard": F.lit(None).cast("int"),
    }).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op6_minhash(spark: SparkSession, sf: str) -> DataFrame:
    """Near-duplicate classes of all documents."""
    return minhash.near_duplicates(table(spark, sf, "documents")).select(
        "doc_id", "n_shingles", "component_id",
        F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op7_token_output(spark: SparkSession, sf: str) -> DataFrame:
    """All documents as packed token-id matrices."""
    return token_output.packed_sequences(
        table(spark, sf, "documents"), tokens.vocabulary(tokens.BYTE_VOCABULARY),
        tokens.vocabulary(tokens.BYTE_RANKS), END_OF_TEXT)


def op8_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens of every document."""
    return token_count.token_counts(
        table(spark, sf, "documents"), tokens.vocabulary(tokens.BYTE_VOCABULARY), TOKEN_LIMIT)


def op9_html_extract(spark: SparkSession, sf: str) -> DataFrame:
    """Main text of every page."""
    return html_extract.extract(table(spark, sf, "pages"))


def op10_cross_polytope(spark: SparkSession, sf: str) -> DataFrame:
    """Near-duplicate classes and link counts of all vectors."""
    return polytope.near_vectors(table(spark, sf, "embeddings"), COSINE).select(
        "vec_id", "n_links", "component_id",
        F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def damaged(rows: DataFrame) -> DataFrame:
    """Conversation rows with the faults that their ids select, nulls as one blank."""
    def filled(name):
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    fate = F.crc32(F.concat(filled("conv_id"), F.lit(":"), filled("turn")).cast("binary")) % 20
    role, text = filled("role"), filled("text")
    return rows.select(
        "conv_id", "turn", F.when(fate == 4, "user").otherwise(role).alias("role"),
        F.when(fate == 1, "").when(fate == 2, F.translate(text, ".!?", "")).otherwise(text)
        .alias("text"), fate.alias("fate"),
    ).where("fate != 0").withColumn(
        "copy", F.explode(F.when(F.col("fate") == 3, F.array(F.lit(1), F.lit(2)))
                          .otherwise(F.array(F.lit(1))))
    ).drop("fate", "copy")


def op11_conversation_repair(spark: SparkSession, sf: str) -> DataFrame:
    """Every conversation after its damage: faults, cheapest repair, digest of what it gives."""
    rows = table(spark, sf, "conversations")
    return conversation_repair.repair_report(damaged(rows), rows.select("conv_id"))


def op12_chat_format(spark: SparkSession, sf: str) -> DataFrame:
    """All conversations and one of control strings, formatted and read back."""
    rows = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    hard = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame(
        [(-1, 0, "user", hard), (-1, 1, "assistant", hard)], rows.schema)
    return chat_format.read_back(chat_format.segments(
        chat_format.format_turns(rows.unionByName(more))))


def op13_spelling_variants(spark: SparkSession, sf: str) -> DataFrame:
    """Spelling variants among all words of the documents, some of them misspelt by rule."""
    words = spelling_variants.word_counts(
        table(spark, sf, "documents"), shortest=6, least=5, every=199)
    return spelling_variants.variant_groups(words)


def pipeline(spark: SparkSession, sf: str) -> DataFrame:
    """The corpus pipeline over all documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf)


# All pairs of vectors of a label, which small tables allow.
OP10_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND CASE WHEN len(embedding) = 0 OR list_count(embedding) < len(embedding) THEN false
             ELSE isfinite(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])))
               AND list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])) > 0 END
), p AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
  ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), r AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings UNION
  SELECT r.a, p.b FROM r JOIN p ON r.b = p.a
), c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM p GROUP BY a)
SELECT e.vec_id, coalesce(n.n_links, 0) AS n_links, c.component_id,
       e.vec_id = c.component_id AS kept
FROM embeddings e JOIN c USING (vec_id) LEFT JOIN n USING (vec_id)
"""

QUERIES = {
    "op1_url_filter": (op1_url_filter, None),
    "op2_decontaminate": (op2_decontaminate, None),
    "op3_pack_tree": (op3_pack_tree, None),
    "op4_toxicity": (op4_toxicity, None),
    "op5_shard_shuffle": (op5_shard_shuffle, None),
    "op6_minhash": (op6_minhash, None),
    "op7_token_output": (op7_token_output, None),
    "op8_token_counts": (op8_token_counts, None),
    "op9_html_extract": (op9_html_extract, None),
    "op10_cross_polytope": (op10_cross_polytope, OP10_SQL),
    "op11_conversation_repair": (op11_conversation_repair, None),
    "op12_chat_format": (op12_chat_format, None),
    "op13_spelling_variants": (op13_spelling_variants, None),
    "pipeline": (pipeline, None),
}
