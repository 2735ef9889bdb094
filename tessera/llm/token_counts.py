"""Operator 8, token counts: rank-synchronous array merging (see bpe.count_symbols)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tessera.llm import bpe
from tessera.llm.common import lean, read_documents, slices, texts_of


def token_counts(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", limit: int = 1024, vocabulary: str = "byte_bpe_50k.json") -> DataFrame:
    """Count each text's tokens: (id, n_bytes, n_tokens, over_limit).

    One narrow pass without a shuffle. A null text counts as empty (0 tokens); an id may be null or occur
    again, each row is counted for itself; an empty table gives no rows; other columns are not read, so
    their names cannot clash. The special token's string counts as one token, as the library has it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = bpe.Counter(vocabulary)
        for part in slices(batches, "text"):
            texts = texts_of(part, "text")
            counts = counter.count(texts)
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(counts, pa.int64()), pa.array([c > limit for c in counts], pa.bool_())],
                names=[id_column, "n_bytes", "n_tokens", "over_limit"],
            )

    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(docs[id_column].alias("id"), docs[text_column].alias("text"))
    return rows.mapInArrow(lean(run), f"`{id_column}` {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read_documents(spark, sf_dir))
