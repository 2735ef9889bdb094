"""Operator 4, packing: shortest-pack-first over the length histogram."""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm import bpe
from tessera.llm.common import hash_modulus, lean, read_documents, shuffle_partitions, slices, staged, texts_of

SEQUENCE_TOKENS = 2048
SEPARATOR_ID = 1


def pack_histogram(histogram: dict[int, int], capacity: int = SEQUENCE_TOKENS) -> list[tuple[int, tuple[int, ...]]]:
    """Packing patterns (how many sequences, the lengths in each) for a histogram of lengths.

    Lengths come longest first. Each goes to the shortest open packs (those with most room), as many packs
    of one pattern at once as there are pieces left; where none has room, new packs open. Work and result
    depend on the number of distinct lengths, not on the number of pieces.
    """
    open_packs: dict[int, list[list]] = {}
    rooms: list[int] = []
    done: list[tuple[int, tuple[int, ...]]] = []

    def put(room: int, count: int, pattern: tuple[int, ...]) -> None:
        if room == 0:
            done.append((count, pattern))
            return
        if not open_packs.get(room):
            open_packs[room] = []
            heapq.heappush(rooms, -room)
        open_packs[room].append([count, pattern])

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        if not 0 < length <= capacity:
            raise ValueError(f"a length of {length} doesn't fit into {capacity}")
        while left:
            while rooms and not open_packs.get(-rooms[0]):
                heapq.heappop(rooms)
            if not rooms or -rooms[0] < length:
                put(capacity - length, left, (length,))
                break
            room = -rooms[0]
            group = open_packs[room][-1]
            taken = min(left, group[0])
            pattern = group[1]
            group[0] -= taken
            if not group[0]:
                open_packs[room].pop()
            put(room - length, taken, (*pattern, length))
            left -= taken
    done.extend((count, pattern) for packs in open_packs.values() for count, pattern in packs)
    return done


def slot_table(patterns: list[tuple[int, tuple[int, ...]]]) -> dict[str, np.ndarray]:
    """For each length the ranks that each slot of each pattern takes, sorted by length and first rank."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for count, pattern in patterns:
        offset = 0
        for length in pattern:
            rank = used.get(length, 0)
            rows.append((length, rank, sequence, offset))
            used[length] = rank + count
            offset += length
        sequence += count
    rows.sort()
    columns = np.array(rows, np.int64).reshape(-1, 4).T
    return dict(zip(("length", "rank", "sequence", "offset"), columns, strict=True))


def _pieces(docs: DataFrame, id_column: str, text_column: str, capacity: int, vocabulary: str) -> DataFrame:
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            at, start, length, crc, total = [], [], [], [], []
            for i, text in enumerate(texts_of(part, "text")):
                ids = np.array([*bpe.encode(text, vocabulary), SEPARATOR_ID], "<u4")
                for first in range(0, len(ids), capacity):
                    piece = ids[first : first + capacity]
                    at.append(i)
                    start.append(first)
                    length.append(len(piece))
                    crc.append(zlib.crc32(piece.tobytes()))
                    total.append(len(ids))
            longs = [pa.array(x, pa.int64()) for x in (start, length, crc, total)]
            yield pa.RecordBatch.from_arrays([part.column("id").take(pa.array(at, pa.int64())), *longs], names=[id_column, "start", "length", "ids_crc32", "doc_tokens"])

    rows = docs.select(docs[id_column].alias("id"), docs[text_column].alias("text"))
    return rows.mapInArrow(lean(run), f"`{id_column}` {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint")


def packed(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", capacity: int = SEQUENCE_TOKENS, vocabulary: str = "byte_bpe_50k.json") -> DataFrame:
    """Pack all documents' tokens into sequences of capacity tokens: a row for each piece.

    A document is its ids and the separator; it is cut at multiples of capacity, so only its last piece is
    packed with others. Columns: id, start, length, ids_crc32, doc_tokens, sequence_id, offset. A null or
    empty text is the separator alone; rows with the same or a null id stay rows of their own; an empty
    table gives no rows; other columns are not read.

    The pieces (numbers only) are written once. A piece's rank within its length comes from counts of
    (length, salt), so no length gathers in one task; only the histogram, of capacity rows at most, and
    the patterns, whose number depends on capacity alone, pass through the driver.
    """
    spark = docs.sparkSession
    salts = shuffle_partitions(spark)
    salt = hash_modulus(F.struct(F.col(id_column), "start"), salts)
    pieces = staged(_pieces(docs, id_column, text_column, capacity, vocabulary).withColumn("salt_", salt))
    counts = staged(pieces.groupBy("length", "salt_").agg(F.count("*").alias("n_")))
    histogram = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("n_")).collect()}
    slots = slot_table(pack_histogram(histogram, capacity))

    before = Window.partitionBy("length").orderBy("salt_").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "salt_", F.coalesce(F.sum("n_").over(before), F.lit(0)).alias("base_"))
    within = Window.partitionBy("length", "salt_").orderBy(F.col(id_column), "start", "ids_crc32")
    ranked = pieces.withColumn("rank_", F.row_number().over(within)).join(bases, ["length", "salt_"])
    ranked = ranked.select(id_column, "start", "length", "ids_crc32", "doc_tokens", (F.col("base_") + F.col("rank_") - 1).alias("rank_"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Ranks start at 0 in each length: one sorted key for both.
        shift = np.int64(44)
        keys = (slots["length"] << shift) | slots["rank"]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank_"))
            at = np.searchsorted(keys, (length << shift) | rank, side="right") - 1
            sequence = slots["sequence"][at] + rank - slots["rank"][at]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(slots["offset"][at])], names=[id_column, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    kind = docs.schema[id_column].dataType.simpleString()
    return ranked.mapInArrow(lean(place), f"`{id_column}` {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(read_documents(spark, sf_dir))
