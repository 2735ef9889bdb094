"""Operator 9, n-gram Jaccard join by PartEnum signatures."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import lean, partition_keys, read_documents, shuffle_partitions, slices, split_by, staged
from tessera.llm.components import components, merged_components
from tessera.llm.partenum import Sketches, block_pairs, signatures_of, similar, sketch, sketches_allow
from tessera.llm.shingles import mix, shingle_sets

#: Signatures that a map task holds before it sends them on, and that a reduce task sorts at once.
SIGNATURES_AT_ONCE, SORTED_AT_ONCE = 500_000, 500_000
#: Distinct digests that a map task remembers.
DIGESTS_HELD = 200_000
#: A signature of so many documents of one map task travels as one list of them.
LIST_FROM = 64
#: Members of a bucket that are compared with one another at once, pairs with one document that are verified together.
BLOCK, VERIFIED_TOGETHER = 256, 64
#: Spanning forests of a bucket's candidates that are verified before all others.
FORESTS = 3
#: Bits of a signature that travel.
CODE_BITS = 48

DOCUMENT, COPY, PAIR, BUCKET, LIST = range(5)
_ROW = "kind int, key bigint, doc bigint, n bigint, data binary"
_NAMES = ["kind", "key", "doc", "n", "data"]


def normalised(text: str | None) -> bytes:
    """UTF-8 with A-Z in lower case; null as empty."""
    return (text or "").encode().lower()


def _rows(kind: int, key: np.ndarray, doc: np.ndarray, n: np.ndarray | None = None, data: list | None = None) -> pa.RecordBatch:
    size = len(key)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(size, kind, np.int32)), pa.array(key.astype(np.int64)), pa.array(doc.astype(np.int64)), pa.array(np.zeros(size, np.int64) if n is None else n), pa.array(data or [None] * size, pa.binary())],
        names=_NAMES,
    )


def _planes(values: np.ndarray) -> bytes:
    """The lowest bytes of 64-bit numbers, then the next ones, and so on: what compresses well stands together."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def _from_planes(raw: bytes, size: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8, 8 * size).reshape(8, size).T).view("<u8").reshape(-1)


def pack_entries(code: np.ndarray, doc: np.ndarray, item: np.ndarray) -> bytes:
    """Entries sorted by code as bytes: differences of codes, places in a table of documents, and what stands for what."""
    table, place = np.unique(doc, return_inverse=True)
    numbers = table.astype(np.int64).view(np.uint64)
    with np.errstate(over="ignore"):
        raw = _planes(np.diff(code, prepend=np.uint64(0))) + _planes(place) + _planes(item ^ doc.view(np.uint64)) + _planes(np.diff(numbers, prepend=np.uint64(0)))
    return len(code).to_bytes(4, "little") + len(table).to_bytes(4, "little") + pa.compress(raw, "zstd", asbytes=True)


def unpack_entries(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, m = int.from_bytes(data[:4], "little"), int.from_bytes(data[4:8], "little")
    raw = pa.decompress(data[8:], 8 * (3 * n + m), "zstd", asbytes=True)
    code, place, other, table = (_from_planes(raw[8 * at :], size) for at, size in ((0, n), (n, n), (2 * n, n), (3 * n, m)))
    with np.errstate(over="ignore"):
        doc = np.cumsum(table, dtype=np.uint64)[place.astype(np.int64)]
        return np.cumsum(code, dtype=np.uint64), doc.view(np.int64), other ^ doc


def _heads(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each run of equal codes starts, and how long it is."""
    start = np.flatnonzero(np.r_[True, code[1:] != code[:-1]]) if len(code) else np.zeros(0, np.int64)
    return start, np.diff(np.r_[start, len(code)])


def _sums(values: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Order-free hash of each run's distinct numbers."""
    with np.errstate(over="ignore"):
        return mix(np.add.reduceat(mix(values), start))


def _sign(length: int, percent: int, keys: np.ndarray, fineness: int):
    """Map side: a row for each document (size, sketch), copies of a set seen before in this task, and signatures.

    Signatures travel packed: a row holds those of many documents for one partition, sorted. A signature
    that LIST_FROM documents of the task share travels with the smallest of them, and their list once,
    however many signatures have the same list.
    """
    buckets = len(keys)
    edges = np.array([(b << CODE_BITS) // buckets for b in range(buckets)], np.uint64)

    def pack(signature: list[np.ndarray], owner: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        if not signature:
            return
        code, doc = np.concatenate(signature) >> np.uint64(64 - CODE_BITS), np.concatenate(owner)
        order = np.lexsort((doc, code))
        code, doc = code[order], doc[order]
        item = doc.astype(np.int64).view(np.uint64)
        start, size = _heads(code)
        large = size >= LIST_FROM
        if large.any():
            inside = np.repeat(large, size)
            short = np.cumsum(size[large]) - size[large]
            names = _sums(item[inside], short)
            _, first = np.unique(names, return_index=True)
            for at in first.tolist():
                members = doc[inside][short[at] : short[at] + size[large][at]]
                listed = np.full(1, names[at], np.uint64).view(np.int64)
                key = keys[int(names[at] % np.uint64(buckets))]
                yield _rows(LIST, np.full(1, key), listed, np.full(1, len(members)), [pa.compress(_planes(np.diff(members, prepend=0)), "zstd", asbytes=True)])
                for low in range(1, len(members), 50_000):
                    some = members[low : low + 50_000]
                    yield _rows(PAIR, np.full(len(some), key), some, np.full(len(some), members[0]))
            item = item.copy()
            item[start[large]] = names
            kept = ~inside
            kept[start[large]] = True
            code, doc, item = code[kept], doc[kept], item[kept]
        cuts = np.searchsorted(code, edges)
        for key, low, high in zip(keys, cuts, np.r_[cuts[1:], len(code)], strict=True):
            if high > low:
                yield _rows(BUCKET, np.array([key]), np.array([0]), np.array([high - low]), [pack_entries(code[low:high], doc[low:high], item[low:high])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, int] = {}
        signature, owner, held = [], [], 0
        for part in slices(batches, "text", 500_000):
            ids = part.column("doc").to_pylist()
            sets = shingle_sets([normalised(t) for t in part.column("text").to_pylist()], length)
            copies, data, fresh = [], [], []
            for i, (doc, features) in enumerate(zip(ids, sets, strict=True)):
                data.append(sketch(features, percent, fineness) if len(features) else b"")
                if doc is None or not len(features):
                    continue
                digest = hashlib.blake2b(features.tobytes(), digest_size=16).digest()
                first = seen.get(digest)
                if first is None:
                    seen[digest] = doc
                    fresh.append(i)
                elif first != doc:
                    copies.append((first, doc))
            found, whose = signatures_of([sets[i] for i in fresh], percent)
            signature.append(found)
            owner.append(np.array([ids[i] for i in fresh], np.int64)[whose])
            held += len(found)
            spread = keys[np.array([0 if d is None else d for d in ids], np.int64) % buckets]
            doc_rows = _rows(DOCUMENT, spread, spread, np.array([len(s) for s in sets], np.int64), data)
            yield doc_rows.set_column(2, "doc", part.column("doc"))
            if copies:
                pairs = np.array(copies, np.int64)
                # key tells the partition here; the first document travels in n.
                yield _rows(COPY, keys[pairs[:, 1] % buckets], pairs[:, 1], pairs[:, 0])
            if held >= SIGNATURES_AT_ONCE:
                yield from pack(signature, owner)
                signature, owner, held = [], [], 0
            if len(seen) > DIGESTS_HELD:
                seen.clear()
        yield from pack(signature, owner)

    return run


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reduce side: of each signature that several documents share, pair them with the smallest.

    Buckets of three or more also leave their members (documents or lists), each set of members once, for
    the documents that the pairs do not join. Packed rows are held as they came; signatures are unpacked
    and sorted a range of them at a time, however many the partition has.
    """
    packed, total = [], 0
    for batch in batches:
        kind = batch.column("kind").to_numpy(zero_copy_only=False)
        if (other := batch.filter(pa.array(kind != BUCKET))).num_rows:
            yield other
        mine = batch.filter(pa.array(kind == BUCKET))
        packed += mine.column("data").to_pylist()
        total += sum(mine.column("n").to_pylist())
    if not packed:
        return
    passes = -(-total // SORTED_AT_ONCE)
    firsts, lasts = [], []
    if passes > 1:
        for data in packed:
            code = unpack_entries(data)[0]
            firsts.append(int(code[0]))
            lasts.append(int(code[-1]))
    low, high = (min(firsts), max(lasts) + 1) if passes > 1 else (0, 1 << 64)
    named: set[int] = set()
    for at in range(passes):
        begin, end = low + (high - low) * at // passes, low + (high - low) * (at + 1) // passes
        parts = []
        for data in packed:
            entries = unpack_entries(data)
            if passes > 1:
                first, last = np.searchsorted(entries[0], np.array([begin, end], np.uint64))
                entries = tuple(x[first:last] for x in entries)
            parts.append(entries)
        code, doc, item = (np.concatenate(x) for x in zip(*parts, strict=True))
        del parts
        yield from _shared(code, doc, item, named)


def _shared(code: np.ndarray, doc: np.ndarray, item: np.ndarray, named: set[int]) -> Iterator[pa.RecordBatch]:
    """Pairs and members of the signatures that occur more than once, or with a list. named: buckets that went out before."""
    order = np.argsort(code, kind="stable")
    code, doc, item = code[order], doc[order], item[order]
    same = code[1:] == code[:-1]
    shared = np.r_[same, False] | np.r_[False, same] | (item != doc.view(np.uint64))
    code, doc, item = code[shared], doc[shared], item[shared]
    if not len(code):
        return
    order = np.lexsort((item, doc, code))
    code, doc, item = code[order], doc[order], item[order]
    once = np.r_[True, (code[1:] != code[:-1]) | (item[1:] != item[:-1])]
    code, doc, item = code[once], doc[once], item[once]
    start, size = _heads(code)
    name = _sums(item, start)
    listed = np.logical_or.reduceat(item != doc.view(np.uint64), start)
    _, first = np.unique(name, return_index=True)  # the same members by many signatures count once
    fresh = first[[x not in named for x in name[first].tolist()]]
    if len(named) < 500_000:
        named.update(name[fresh].tolist())
    kept = np.zeros(len(start), bool)
    kept[fresh] = True
    lowest = np.repeat(doc[start], size)
    chosen = np.repeat(kept & (size > 1), size) & (doc != lowest)
    pairs = np.unique(np.stack([lowest[chosen], doc[chosen]], 1), axis=0)
    for at in range(0, len(pairs), 50_000):
        some = pairs[at : at + 50_000]
        yield _rows(PAIR, np.zeros(len(some)), some[:, 1], some[:, 0])
    many = np.flatnonzero(kept & ((size > 2) | listed))
    for at in range(0, len(many), 2_000):
        some = many[at : at + 2_000].tolist()
        data = [item[start[b] : start[b] + size[b]].astype("<u8").tobytes() + (item[start[b] : start[b] + size[b]] != doc[start[b] : start[b] + size[b]].view(np.uint64)).tobytes() for b in some]
        yield _rows(BUCKET, name[some].view(np.int64), np.zeros(len(some)), size[some], data)


def _members(found: DataFrame) -> DataFrame:
    """(key, doc): the documents of each bucket, lists put back."""

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 1_000):
                part = batch.slice(first, 1_000)
                sizes = part.column("n").to_numpy(zero_copy_only=False)
                blobs = part.column("data").to_pylist()
                item = np.concatenate([np.frombuffer(b, "<i8", n) for b, n in zip(blobs, sizes.tolist(), strict=True)])
                listed = np.concatenate([np.frombuffer(b, np.bool_, n, 8 * n) for b, n in zip(blobs, sizes.tolist(), strict=True)])
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(part.column("key").to_numpy(), sizes)), pa.array(item), pa.array(listed)], names=["key", "item", "listed"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, n, data in zip(*(batch.column(c).to_pylist() for c in ("doc", "n", "data")), strict=True):
                docs = np.cumsum(_from_planes(pa.decompress(data, 8 * n, "zstd", asbytes=True), n).view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, name)), pa.array(docs)], names=["item", "doc"])

    buckets = found.where(F.col("kind") == BUCKET).dropDuplicates(["key"]).select("key", "n", "data")
    items = staged(buckets.mapInArrow(lean(opened), "key bigint, item bigint, listed boolean"))
    plain = items.where("NOT listed").select("key", F.col("item").alias("doc"))
    lists = found.where(F.col("kind") == LIST).dropDuplicates(["doc"]).select("doc", "n", "data").mapInArrow(lean(read), "item bigint, doc bigint")
    return plain.union(items.where("listed").join(lists, "item").select("key", "doc").distinct())


def _likely(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that their sketches allow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_a, n_b, s_a, s_b = (batch.column(c).to_pylist() for c in ("n_a", "n_b", "s_a", "s_b"))
            keep = [sketches_allow(x, n, y, m, percent) for x, n, y, m in zip(s_a, n_a, s_b, n_b, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = sketches.select(F.col("doc").alias("a"), F.col("n").alias("n_a"), F.col("data").alias("s_a"))
    right = sketches.select(F.col("doc").alias("b"), F.col("n").alias("n_b"), F.col("data").alias("s_b"))
    return pairs.join(right, "b").join(left, "a").select("a", "b", "n_a", "n_b", "s_a", "s_b").mapInArrow(lean(run), "a bigint, b bigint")


def _verified(pairs: DataFrame, texts: DataFrame, length: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole texts reach the similarity.

    A document's pairs are dealt into groups of about VERIFIED_TOGETHER: its text goes to each group once,
    and its partners' texts once a pair, so no document gathers all its partners in one task.
    """
    spark = pairs.sparkSession
    many = pairs.groupBy("a").agg(F.ceil(F.count("*") / VERIFIED_TOGETHER).alias("groups"))
    dealt = pairs.join(many, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("groups")).cast("int").alias("part"))
    dealt = staged(dealt)
    wanted = dealt.select("a", "part", F.col("a").alias("doc"), F.lit(0).alias("side")).distinct().union(dealt.select("a", "part", F.col("b").alias("doc"), F.lit(1).alias("side")))
    held = split_by(texts, wanted.select("doc").distinct())[0]
    met = wanted.join(held, "doc").repartition(shuffle_partitions(spark), "a", "part").sortWithinPartitions("a", "part", "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, hubs = None, []
        for part in slices(batches, "text", 500_000):
            sets = shingle_sets([normalised(t) for t in part.column("text").to_pylist()], length)
            found = []
            for a, p, doc, side, features in zip(*(part.column(c).to_pylist() for c in ("a", "part", "doc", "side")), sets, strict=True):
                if group != (a, p):
                    group, hubs = (a, p), []
                if side == 0:
                    hubs.append(features)
                elif any(similar(h, features, percent) for h in hubs):
                    found.append((a, doc))
            pairs = np.array(found, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    return met.mapInArrow(lean(run), "a bigint, b bigint")


def _rest(members: DataFrame, labels: DataFrame, known: DataFrame, percent: int, forests: int | None) -> DataFrame:
    """(key, a, b): pairs, a < b, of bucket members that are still in different components and that sketches allow.

    Buckets that are one component already need nothing. In the others, members outside the bucket's
    largest component are compared with all of its members, in blocks: a bucket of up to BLOCK members is
    one block; in a larger one both sides are cut into groups of about BLOCK, and each two groups are a block of
    their own, so no task takes a whole large bucket, and one large component with a few documents beside
    it costs each of its members one row. Only pairs that may be similar leave a block; with forests, a few
    for each member (see block_pairs).
    """
    held = staged(members.join(labels.select(F.col("node").alias("doc"), "component"), "doc", "left").select("key", "doc", F.coalesce("component", "doc").alias("component")))
    each = held.groupBy("key", "component").agg(F.count("*").alias("n"))
    open_ = each.groupBy("key").agg(F.sum("n").alias("size"), F.max(F.struct("n", "component")).alias("main"), F.count("*").alias("parts")).where("parts > 1")
    cuts = lambda n: F.ceil(n / BLOCK).cast("int")
    open_ = open_.select("key", F.col("main.component").alias("main"), (F.col("size") <= BLOCK).alias("small"), cuts(F.col("main.n")).alias("main_cuts"), cuts(F.col("size") - F.col("main.n")).alias("rest_cuts"))
    some = held.join(open_, "key").join(known, "doc")
    is_main = F.col("component") == F.col("main")
    mine = F.pmod(F.xxhash64("doc"), F.when(is_main, F.col("main_cuts")).otherwise(F.col("rest_cuts"))).cast("int")
    some = some.select("key", "doc", "component", "n", "data", "small", "main_cuts", "rest_cuts", is_main.alias("is_main"), mine.alias("mine"))
    block = lambda kind, i, j, side: F.struct(F.lit(kind).alias("k"), i.cast("int").alias("i"), j.cast("int").alias("j"), side.cast("int").alias("side"))
    one = F.array(block(0, F.lit(0), F.lit(0), F.lit(0)))
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    of_main = F.transform(upto(F.col("rest_cuts")), lambda i: block(1, i, F.col("mine"), F.lit(2)))
    with_main = F.transform(upto(F.col("main_cuts")), lambda j: block(1, F.col("mine"), j, F.lit(1)))
    with_rest = F.transform(upto(F.col("rest_cuts")), lambda i: block(2, F.least(i, F.col("mine")), F.greatest(i, F.col("mine")), F.when(i == F.col("mine"), 0).when(F.col("mine") < i, 1).otherwise(2)))
    blocks = F.when(F.col("small"), one).when(F.col("is_main"), of_main).otherwise(F.concat(with_main, with_rest))
    dealt = some.select("key", "doc", "component", "n", "data", F.explode(blocks).alias("at"))
    dealt = dealt.select("key", F.xxhash64("key", "at.k", "at.i", "at.j").alias("block"), "doc", "component", "n", "data", F.col("at.side").alias("side"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def compare(block: pa.Table) -> pa.RecordBatch:
            doc, component, n, side = (block.column(c).to_numpy() for c in ("doc", "component", "n", "side"))
            i, j = block_pairs(Sketches(block.column("data").to_pylist(), n, percent), component, side, forests)
            pairs = np.unique(np.sort(np.stack([doc[i], doc[j]], 1), axis=1), axis=0)
            key = np.full(len(pairs), block.column("key")[0].as_py(), np.int64)
            return pa.RecordBatch.from_arrays([pa.array(key), pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["key", "a", "b"])

        held: list[pa.RecordBatch] = []
        name = None
        for batch in batches:
            names = batch.column("block").to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(names[1:] != names[:-1]) + 1
            for low, high in zip(np.r_[0, cuts], np.r_[cuts, len(names)], strict=True):
                if high > low:
                    if name is not None and names[low] != name:
                        yield compare(pa.Table.from_batches(held))
                        held = []
                    name = names[low]
                    held.append(batch.slice(int(low), int(high - low)))
        if held:
            yield compare(pa.Table.from_batches(held))

    sorted_ = dealt.repartition(shuffle_partitions(members.sparkSession), "block").sortWithinPartitions("block")
    return sorted_.mapInArrow(lean(run), "key bigint, a bigint, b bigint")


def jaccard_classes(docs: DataFrame, length: int = 5, percent: int = 80, id_column: str = "doc_id", text_column: str = "text", fineness: int = 2) -> DataFrame:
    """Classes of documents linked by a Jaccard similarity of percent / 100 or more: id, n_shingles, component_id.

    A set is a text's distinct shingles of length words (A-Z in lower case; the whole text if it has fewer
    words). component_id is the smallest id reachable over links, or the id itself. Ids are integers (they are
    cast to bigint; others raise Spark's cast error). Null and empty texts have no shingles and no links; rows with
    a null id have a null component; rows that share an id are one document to the links and are each
    returned; an empty table gives no rows; other columns are not read.

    Documents that share a PartEnum signature are candidates: each with the smallest id of its bucket
    first; then, in buckets that are not one component yet, a few spanning forests of the members that may
    be similar; then all pairs of different components that are left. Sketches drop candidates that cannot be
    similar, and whole texts decide. So every component is exact, and a bucket of many copies costs a few
    pairs a copy. Sketches have more pieces than fineness times the largest distance: finer ones drop
    more candidates and take more space; the result is the same.
    """
    spark = docs.sparkSession
    buckets = shuffle_partitions(spark)
    texts = docs.select(docs[id_column].cast("bigint").alias("doc"), docs[text_column].alias("text"))
    signed = texts.mapInArrow(lean(_sign(length, percent, partition_keys(buckets), fineness)), _ROW).repartition(buckets, "key")
    found = staged(signed.mapInArrow(lean(_gather), _ROW), "kind")
    sizes = found.where(F.col("kind") == DOCUMENT).select("doc", "n", "data")
    known = sizes.where("doc IS NOT NULL AND n > 0")
    copies = found.where(F.col("kind") == COPY).select(F.col("n").alias("a"), F.col("doc").alias("b"))
    pairs = found.where(F.col("kind") == PAIR).select(F.col("n").alias("a"), F.col("doc").alias("b")).distinct()
    some = texts.where("doc IS NOT NULL")
    tested = staged(_likely(pairs, known, percent).distinct())
    labels = components(staged(_verified(tested, some, length, percent).union(copies)))
    members = staged(_members(found))
    for forests in (FORESTS, None):
        rest = staged(_rest(members, labels, known, percent, forests))
        if rest.isEmpty():
            break
        fresh = staged(rest.select("a", "b").distinct().join(tested, ["a", "b"], "left_anti"))
        more = staged(_verified(fresh, some, length, percent))
        if not more.isEmpty():
            labels = merged_components(labels, more)
        tested = tested.union(fresh)
        members = members.join(rest.select("key").distinct(), "key", "left_semi")  # the other buckets have no pair that may be similar
    joined = sizes.join(labels, sizes["doc"] == labels["node"], "left")
    kind = docs.schema[id_column].dataType
    return joined.select(F.col("doc").cast(kind).alias(id_column), F.col("n").alias("n_shingles"), F.coalesce("component", "doc").cast(kind).alias("component_id"))


def distinct_documents(docs: DataFrame, length: int = 5, percent: int = 80, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """docs without all but the smallest id of each class of jaccard_classes, with the same columns.

    Rows with a null id stay; rows that share an id are one document and stay or go together; documents
    without words are in no class and stay; an empty table gives no rows. Other columns pass through, whatever
    their names. Only rows whose id a bitmap of bounded size marks go through the join's shuffle.
    """
    classes = jaccard_classes(docs, length, percent, id_column, text_column)
    gone = staged(classes.where(F.col(id_column) != F.col("component_id")).select(F.col(id_column).cast("bigint").alias("doc")).distinct())
    whole = docs.select(docs[id_column].cast("bigint").alias("doc"), F.struct("*").alias("row"))
    maybe, stay = split_by(whole, gone)
    return maybe.join(gone, "doc", "left_anti").select("row.*").union(stay.select("row.*"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(read_documents(spark, sf_dir), length=3, percent=90)
