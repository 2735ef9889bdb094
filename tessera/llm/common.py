"""What the training-data operators share: staged tables, batch slicing, word rules.

Nothing outside this subpackage imports it, and it imports nothing from the rest of the library.
"""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: white space that separates words, [\x20\x09-\x0D].
SPACE_CLASS = r"[\x20\x09-\x0D]"


def read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Where it is unset, a local session gets a folder of its own; a cluster must name one.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="tessera-")
    spark.sparkContext.setCheckpointDir(own)
    return own


def staged(df: DataFrame, partition_by: str | None = None) -> DataFrame:
    """Write df to the shared folder and read it back, which cuts its lineage.

    The files survive lost executors; they go when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tessera-{uuid.uuid4().hex}"
    writer = df.write.partitionBy(partition_by) if partition_by else df.write
    writer.parquet(path)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def slices(batches: Iterable[pa.RecordBatch], column: str, most_bytes: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that a slice's texts take about most_bytes at most (a single row may take more)."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i, size in enumerate(sizes.tolist()):
            if held and held + size > most_bytes:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        if start < batch.num_rows:
            yield batch.slice(start)


def lean(run):
    """A function for mapInArrow whose worker gives memory that it no longer needs back to the system when a task ends.

    Workers outlive their tasks; what their allocators keep would count beside the next tasks' memory.
    """

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
            if trim:
                trim(0)

    return held


def texts_of(batch: pa.RecordBatch, column: str) -> list[str]:
    """A column's strings, null as empty."""
    return [x or "" for x in batch.column(column).to_pylist()]


def words_column(text: Column) -> Column:
    """array<string>: the words [^\\x20\\x09-\\x0D]+ of a text; null gives none."""
    # array_remove is compiled; trimming by a set of characters walks the whole text.
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS + "+"), "")


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int, id_column: str, text_column: str) -> DataFrame | None:
    """Texts of about `rows` labelled documents: _q_id, _q_label, text; None where no label is usable.

    labels has _q_id and _q_label; null ids go, and of an id's contradictory labels the lowest counts. The
    ids are chosen by a hash. They are twice `rows` at most, so sending them to every task is safe.
    """
    marked = labels.where("_q_id IS NOT NULL AND _q_label IS NOT NULL").groupBy("_q_id").agg(F.min("_q_label").alias("_q_label"))
    total = marked.count()
    if not total:
        return None
    place = F.pmod(F.xxhash64("_q_id"), F.lit(1 << 30))
    chosen = marked.where(place < int((1 << 30) * min(1.0, rows / total))).limit(2 * rows)
    return docs.select(docs[id_column].alias("_q_id"), docs[text_column].alias("text")).join(F.broadcast(chosen), "_q_id")


def split_by(rows: DataFrame, needed: DataFrame, most_bits: int = 26) -> tuple[DataFrame, DataFrame]:
    """The rows whose doc may be among needed's (both bigint doc), and those whose doc is surely not.

    A bitmap of hashed ids goes to every task; it keeps most whole texts out of a join's shuffle. It has about 16 bits
    for each needed id, at most 2^most_bits: a table of 2^most_bits / 64 rows (16 MB) whatever the input. With
    more ids than that more rows pass by chance; those are left to that join. A null doc is surely not among them.
    """
    needed = needed.where("doc IS NOT NULL").select("doc")
    bits = min(most_bits, max(16, (16 * needed.count()).bit_length()))
    place = F.pmod(F.xxhash64("doc"), F.lit(1 << bits))
    bitmap = needed.select(F.shiftright(place, 6).alias("word_"), F.pmod(place, F.lit(64)).cast("int").alias("bit_"))
    bitmap = staged(bitmap.groupBy("word_").agg(F.bit_or(F.expr("shiftleft(1L, bit_)")).alias("bits_")))
    marked = rows.withColumn("word_", F.shiftright(place, 6)).join(F.broadcast(bitmap), "word_", "left")
    bit = F.pmod(place, F.lit(64)).cast("int")
    held = F.expr("bits_ IS NOT NULL AND doc IS NOT NULL") & (F.call_function("shiftrightunsigned", F.col("bits_"), bit).bitwiseAND(F.lit(1).cast("bigint")) == 1)
    held = F.coalesce(held, F.lit(False))
    return marked.where(held).select(rows.columns), marked.where(~held).select(rows.columns)


def hash_modulus(value: Column, salts: int) -> Column:
    """A non-negative salt below salts."""
    return F.pmod(F.xxhash64(value), F.lit(salts)).cast("int")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spark_hash(values: np.ndarray) -> np.ndarray:
    """Spark's hash() of bigints, by which repartition() deals rows out (Murmur3, 32 bits, seed 42)."""
    rotate = lambda x, r: ((x << np.uint32(r)) | (x >> np.uint32(32 - r))).astype(np.uint32)
    h = np.full(len(values), 42, np.uint32)
    bits = values.astype(np.int64).view(np.uint64)
    with np.errstate(over="ignore"):
        for half in (bits & np.uint64(0xFFFFFFFF), bits >> np.uint64(32)):
            k = rotate(half.astype(np.uint32) * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593)
            h = rotate(h ^ k, 13) * np.uint32(5) + np.uint32(0xE6546B64)
        h ^= np.uint32(8)
        h = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B)
        h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    return (h ^ (h >> np.uint32(16))).view(np.int32)


def partition_keys(partitions: int) -> np.ndarray:
    """For each of so many partitions a bigint that repartition(partitions, key) deals to it.

    Numbers from 0 would leave some partitions empty and put several into others.
    """
    keys = np.arange(partitions * (10 + 2 * partitions.bit_length()), dtype=np.int64)
    found, first = np.unique(spark_hash(keys).astype(np.int64) % partitions, return_index=True)
    out = np.arange(partitions, dtype=np.int64)  # a partition that no key reaches shares another's
    out[found] = keys[first]
    return out


def tokenizer_file(name: str) -> str:
    """Path of a public tokenizer's file (TESSERA_TOKENIZERS names another folder)."""
    if folder := os.environ.get("TESSERA_TOKENIZERS"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)
