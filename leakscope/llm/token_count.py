"""Exact token counts: the pieces of each distinct pre-token are counted once.

A document's count is the sum, over its distinct pre-tokens, of frequency times pieces. No ids of
a document are ever held. The join of frequencies to piece counts takes place inside the task that
reads the document: shuffling (document, pre-token) rows instead would write several times the
input, as a document has hundreds of distinct pre-tokens.
"""

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leakscope.llm import tokens
from leakscope.llm.common import mapped


def token_counts(docs: DataFrame, path: str, limit: int) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of `docs` (columns doc_id, text).

    A null text counts as empty: no bytes, no tokens. A null doc_id is kept. Repeated rows are
    counted each; other columns are ignored.
    """

    def run(batches):
        units = tokens.units(path, True, None)
        for (ids,), texts in tokens.parts(batches):
            counts = units.of(texts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()),
                 pa.array([len(t.encode()) for t in texts], pa.int64()),
                 pa.array(counts, pa.int64()),
                 pa.array([n > limit for n in counts], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return mapped(
        docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run,
        "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
