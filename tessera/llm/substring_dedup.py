"""Operator 6, substring dedup: super-k-mer partitioning by minimisers."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import lean, read_documents, shuffle_partitions, slices, split_by, staged
from tessera.llm.shingles import Words

WINDOW = 20
MINIMISER = 6
#: Bytes of super-k-mers that a task holds before it sends them on, windows of one at most, buckets a partition.
HELD_BYTES, MOST_WINDOWS, BUCKETS_EACH = 16_000_000, 64, 8

RANGE, PACKED = 0, 1
_ROW = "kind int, bucket int, doc bigint, mark bigint, first bigint, n bigint, data binary"
_NAMES = ["kind", "bucket", "doc", "mark", "first", "n", "data"]
_FAR = np.uint64(2**64 - 1)


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of width values (shorter at the end), by doubling."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.r_[np.minimum(out[:-step], out[step:]), out[len(out) - step :]]
        have += step
    return out


def super_kmers(words: Words, window: int = WINDOW, minimiser: int = MINIMISER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, windows, minimiser's hash) of the super-k-mers: runs of windows with the same minimiser.

    A window's minimiser is the smallest hash among its runs of `minimiser` words, so equal windows always
    agree on it. Runs of more than MOST_WINDOWS windows are cut.
    """
    at, _ = words.runs(window)
    if not len(at):
        return at, at, np.zeros(0, np.uint64)
    place, hashes = words.runs(minimiser)
    values = np.full(len(words.text), _FAR)
    values[place] = hashes
    lowest = _sliding_min(values, window - minimiser + 1)[at]
    fresh = np.r_[True, (lowest[1:] != lowest[:-1]) | (at[1:] != at[:-1] + 1)]
    begin = np.flatnonzero(fresh)
    place = np.arange(len(at)) - begin[np.cumsum(fresh) - 1]
    begin = np.flatnonzero(place % MOST_WINDOWS == 0)
    return at[begin], np.diff(np.r_[begin, len(at)]), lowest[begin]


def _ranges(doc: np.ndarray, mark: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs (doc, mark, first, count) of consecutive starts."""
    order = np.lexsort((start, mark, doc))
    doc, mark, start = doc[order], mark[order], start[order]
    fresh = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (mark[1:] != mark[:-1]) | (start[1:] > start[:-1] + 1)])
    last = np.r_[fresh[1:], len(doc)] - 1
    return doc[fresh], mark[fresh], start[fresh], start[last] - start[fresh] + 1


def _range_rows(doc: np.ndarray, mark: np.ndarray, first: np.ndarray, count: np.ndarray) -> pa.RecordBatch:
    size = len(doc)
    kind, bucket = pa.array(np.full(size, RANGE, np.int32)), pa.array(((doc + first) % 1_000_003).astype(np.int32))
    return pa.RecordBatch.from_arrays([kind, bucket, *(pa.array(np.asarray(x, np.int64)) for x in (doc, mark, first, count)), pa.nulls(size, pa.binary())], names=_NAMES)


def _send(buckets: int, window: int):
    """Map side: cut texts into super-k-mers and pack them by bucket, each different one of a task once.

    Of equal super-k-mers the one that starts first travels; the windows of the others start later than
    the same windows of that one, so they are already known to repeat and go out as ranges.
    """

    def pack(held: dict[bytes, tuple[int, int, int, int, int]]) -> Iterator[pa.RecordBatch]:
        order: list[list[bytes]] = [[] for _ in range(buckets)]
        for text, entry in held.items():
            order[entry[4]].append(text)
        for bucket, texts in enumerate(order):
            if texts:
                entries = np.array([(*held[t][:4], len(t)) for t in texts], np.int64)
                raw = entries.T.astype("<i8").tobytes() + b" ".join(texts)
                data = len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)
                yield pa.RecordBatch.from_arrays([pa.array([PACKED], pa.int32()), pa.array([bucket], pa.int32()), *(pa.array([x], pa.int64()) for x in (0, 0, 0, len(texts))), pa.array([data], pa.binary())], names=_NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, tuple[int, int, int, int, int]] = {}
        size = 0
        for part in slices(batches, "text", 1_000_000):
            ids, marks = part.column("doc").to_pylist(), part.column("mark").to_pylist()
            words = Words([b"" if d is None else (t or "").encode() for d, t in zip(ids, part.column("text").to_pylist(), strict=True)])
            first, count, lowest = super_kmers(words, window)
            text = words.text[first] if len(first) else first
            low, high = words.start[first], words.end[first + count + window - 2]
            start = first - words.first[text]
            bucket = (lowest % np.uint64(buckets)).astype(np.int64)
            joined, repeats = words.joined, []
            for t, a, b, s, n, k in zip(text.tolist(), low.tolist(), high.tolist(), start.tolist(), count.tolist(), bucket.tolist(), strict=True):
                key, doc, mark = joined[a:b], ids[t], marks[t]
                other = held.get(key)
                if other is None:
                    held[key] = (doc, mark, s, n, k)
                    size += b - a
                elif (doc, mark, s) < other[:3]:
                    repeats.append(other[:4])
                    held[key] = (doc, mark, s, n, k)
                elif (doc, mark, s) > other[:3]:
                    repeats.append((doc, mark, s, n))
            if repeats:
                yield _range_rows(*np.array(repeats, np.int64).T)
            if size >= HELD_BYTES:
                yield from pack(held)
                held, size = {}, 0
        yield from pack(held)

    return run


def _repeated(data: list[tuple[int, bytes]], window: int) -> Iterator[pa.RecordBatch]:
    """Ranges of a bucket's windows whose words also start earlier: sort the windows, compare equals, keep the first."""
    tables, texts = [], []
    for n, blob in data:
        raw = pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), "zstd", asbytes=True)
        tables.append(np.frombuffer(raw[: 40 * n], "<i8").reshape(5, n))
        texts.append(raw[40 * n :])
    doc, mark, start, windows, _ = np.concatenate(tables, 1)
    words = Words.of_joined(b" ".join(texts), windows + window - 1)
    del tables, texts
    at, code = words.runs(window)
    order = np.argsort(code)
    code = code[order]
    same = code[1:] == code[:-1]
    shared = np.r_[same, False] | np.r_[False, same]
    at, code = at[order][shared], code[shared]
    if not len(at):
        return
    entry = words.text[at]
    doc, mark, start = doc[entry], mark[entry], start[entry] + at - words.first[entry]
    order = np.lexsort((start, mark, doc, code))
    at, code, doc, mark, start = at[order], code[order], doc[order], mark[order], start[order]
    head = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
    head = np.repeat(head, np.diff(np.r_[head, len(code)]))
    low, high, joined = words.start[at].tolist(), words.end[at + window - 1].tolist(), words.joined
    equal = np.array([joined[low[i] : high[i]] == joined[low[h] : high[h]] for i, h in enumerate(head.tolist())], bool)
    later = equal & ((doc != doc[head]) | (mark != mark[head]) | (start != start[head]))
    if not equal.all():  # different windows with one hash: settle these by their words
        seen: dict[bytes, tuple[int, int, int]] = {}
        for i in np.flatnonzero(~equal).tolist():
            text, mine = joined[low[i] : high[i]], (int(doc[i]), int(mark[i]), int(start[i]))
            later[i] = seen.setdefault(text, mine) != mine
    if later.any():
        found = _ranges(doc[later], mark[later], start[later])
        for first in range(0, len(found[0]), 50_000):
            yield _range_rows(*(x[first : first + 50_000] for x in found))


def _receive(window: int):
    """Reduce side: rows come sorted by bucket; ranges pass through, each bucket is judged as a whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, data = -1, []
        for batch in batches:
            packed = batch.column("kind").to_numpy(zero_copy_only=False) == PACKED
            if not packed.all():
                yield batch.filter(pa.array(~packed))
            mine = batch.filter(pa.array(packed))
            for b, n, blob in zip(mine.column("bucket").to_pylist(), mine.column("n").to_pylist(), mine.column("data").to_pylist(), strict=True):
                if b != bucket and data:
                    yield from _repeated(data, window)
                    data = []
                bucket = b
                data.append((n, blob))
        if data:
            yield from _repeated(data, window)

    return run


def covered(ranges: np.ndarray, n_words: int, window: int = WINDOW) -> np.ndarray:
    """Which words the windows of these ranges (first window, count) cover."""
    change = np.zeros(n_words + 1, np.int64)
    np.add.at(change, ranges[:, 0], 1)
    np.add.at(change, ranges[:, 0] + ranges[:, 1] + window - 1, -1)
    return np.cumsum(change[:-1]) > 0


def repeated_ranges(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", window: int = WINDOW) -> DataFrame:
    """(doc, mark, first, n): runs of n windows, from word `first`, whose words also start earlier in the corpus.

    mark is a hash of the text, which tells different texts of one id apart.
    """
    partitions = shuffle_partitions(docs.sparkSession)
    rows = docs.select(docs[id_column].cast("bigint").alias("doc"), F.xxhash64(docs[text_column]).alias("mark"), docs[text_column].alias("text"))
    sent = rows.mapInArrow(lean(_send(partitions * BUCKETS_EACH, window)), _ROW)
    met = sent.repartition(partitions, "bucket").sortWithinPartitions("bucket")
    return met.mapInArrow(lean(_receive(window)), _ROW).select("doc", "mark", "first", "n")


def substring_dedup(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", window: int = WINDOW, keep_text: bool = False) -> DataFrame:
    """Remove each word covered by a window of `window` words that also starts earlier: id, n_words, n_removed, kept_sha256[, kept].

    Earlier is a smaller id, or the same id and a smaller hash of the text, or both the same and an earlier start; windows are judged on the input. The kept
    words are joined by one blank. Null and empty texts have no words. Rows with a null id take no part and
    keep all their words. Rows that share id and text are one document: what one of them loses, so do the
    others; different texts under one id are judged each on its own. An empty table gives no rows; other columns are not read.

    Super-k-mers travel packed and compressed, one row for a task and bucket; a bucket holds those of a
    range of minimisers, about 1 / (partitions * BUCKETS_EACH) of the corpus, and is judged alone. Copies
    within a task travel once, so a bucket gets a passage at most once from each task.
    """
    ranges = staged(repeated_ranges(docs, id_column, text_column, window))
    merged = ranges.groupBy("doc", "mark").agg(F.collect_list(F.struct("first", "n")).alias("ranges"))
    rows = docs.select(docs[id_column].alias("id"), docs[id_column].cast("bigint").alias("doc"), F.xxhash64(docs[text_column]).alias("mark"), docs[text_column].alias("text"))
    # Only texts that may lose something go through the join's shuffle; a bitmap of fixed size tells which.
    held, free = split_by(rows, ranges.select("doc").distinct())
    joined = held.join(merged, ["doc", "mark"], "left").select("id", "text", "ranges").union(free.select("id", "text", F.lit(None).cast(merged.schema["ranges"].dataType)))
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", 1_000_000):
            out = []
            for text, found in zip(part.column("text").to_pylist(), part.column("ranges").to_pylist(), strict=True):
                words = (text or "").encode().split()
                total = len(words)
                if found:
                    gone = covered(np.array([(r["first"], r["n"]) for r in found], np.int64), total, window)
                    words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                kept = b" ".join(words)
                out.append((total, total - len(words), hashlib.sha256(kept).hexdigest(), *[kept.decode()] * keep_text))
            kinds = [pa.int64(), pa.int64(), pa.string(), *[pa.string()] * keep_text]
            columns = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("id"), *columns], names=[id_column, "n_words", "n_removed", "kept_sha256", *["kept"] * keep_text])

    return joined.mapInArrow(lean(run), f"`{id_column}` {kind}, n_words bigint, n_removed bigint, kept_sha256 string" + ", kept string" * keep_text)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(read_documents(spark, sf_dir))
