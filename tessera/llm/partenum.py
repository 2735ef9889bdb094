"""PartEnum signatures and sketches of sets of 64-bit features; numpy only."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations

import numpy as np

from tessera.llm.shingles import mix

BAND_RATIO = 1.25
#: Hashes of the domain that a set with too many empty pieces tries, one after another.
LEVELS = 5
_LOW = np.uint64(0xFFFFFFFF)


@dataclass(frozen=True)
class Band:
    """How sets of sizes low to high are signed.

    The domain is cut into parts, each of cells pieces, of which any loose may differ. spare parts are more
    than the distance needs, so that a set may leave out as many parts of empty pieces; -1: it leaves none out.
    """

    number: int
    low: int
    high: int
    distance: int
    parts: int
    cells: int
    loose: int
    spare: int


def most_distance(size: int, percent: int) -> int:
    """Largest symmetric difference of two sets that reach the similarity, the smaller one of this size."""
    union = 100 * size // percent
    return union - -(-percent * union // 100)


def pair_distance(size_a, size_b, percent: int):
    """Largest symmetric difference of two sets of these sizes that reach the similarity; numbers or arrays."""
    return (100 - percent) * (size_a + size_b) // (100 + percent)


def _band(number: int, low: int, high: int, percent: int) -> Band:
    distance = pair_distance(high, high, percent)
    if distance == 0:
        return Band(number, low, high, 0, 1, 1, 0, -1)
    if distance <= 2:  # one partition, of many cells: small sets must not leave a signature empty
        return Band(number, low, high, distance, 1, 8 if distance == 1 else 7, distance, -1)
    needed, spare = distance // 2 + 1, 0
    if low < 16:
        return Band(number, low, high, distance, needed, 3, 1, -1)
    for _ in range(30):  # as many spare parts as are likely to have two empty cells, and a deviation more
        parts = needed + spare
        weak = min(1.0, 3 * math.exp(-0.85 * low / parts * 2 / 3))
        likely = int(parts * weak + math.sqrt(parts * weak * (1 - weak)))
        if likely <= spare:
            break
        if likely > needed // 2:  # more parts would leave more pieces empty: rely on the levels
            spare = 0
            break
        spare += max(1, (likely - spare) // 2)
    return Band(number, low, high, distance, needed + spare, 3, 1, spare)


@lru_cache(maxsize=64)
def bands(percent: int, largest: int) -> tuple[Band, ...]:
    """Bands of set sizes up to largest and one beyond; a similar pair lies in one band or in two neighbours."""
    high = 1
    while pair_distance(high + 1, high + 1, percent) == 0:
        high += 1
    out = [_band(0, 1, high, percent)]
    while out[-1].low <= largest:
        low = out[-1].high + 1
        out.append(_band(len(out), low, max(low, int(low * BAND_RATIO), 100 * low // percent), percent))
    return tuple(out)


def _spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The places starts[i], starts[i] + 1, ... counts[i] of them, for all i."""
    return np.arange(counts.sum()) + np.repeat(starts - (np.cumsum(counts) - counts), counts)


def _signed(flat: np.ndarray, start: np.ndarray, size: np.ndarray, jobs: list[tuple[int, Band]], level: int) -> tuple[list[np.ndarray], list[np.ndarray], list[tuple[int, Band]]]:
    """Signatures of jobs (set, band) whose bands have the same cells and loose, their sets, and the jobs left to the next level.

    flat holds the sets' features one after another, each sorted.
    """
    cells, loose = jobs[0][1].cells, jobs[0][1].loose
    which = np.array([i for i, _ in jobs], np.int64)
    parts = np.array([b.parts for _, b in jobs], np.int64)
    number = np.array([b.number for _, b in jobs], np.uint64)
    spare = np.array([b.spare for _, b in jobs], np.int64)
    feature = flat[_spread(start[which], size[which])]
    row = np.cumsum(parts) - parts
    with np.errstate(over="ignore"):
        piece = ((feature >> np.uint64(32)) * np.repeat((parts * cells).astype(np.uint64), size[which])) >> np.uint64(32)
        piece = piece.astype(np.int64) + np.repeat(row * cells, size[which])
        held = np.bincount(piece, minlength=int(parts.sum()) * cells)
        # Sums over a piece's features don't depend on their order.
        total = np.r_[np.uint64(0), np.cumsum(mix(feature ^ np.uint64(0xA5A5A5A5A5A5A5A5)) | np.uint64(1))]
        end = np.cumsum(held)
        sums = mix(total[end] - total[end - held]).reshape(-1, cells)
        held = held.reshape(-1, cells)
        place = np.arange(len(sums)) - np.repeat(row, parts)
        part = mix(place.astype(np.uint64) * np.uint64(1_000_003) + np.repeat(number * np.uint64(LEVELS) + np.uint64(level), parts))
        found, empty = [], []
        for code, kept in enumerate(combinations(range(cells), cells - loose)):
            signature = part + np.uint64(code)
            for cell in kept:
                signature = mix(signature * np.uint64(0x9E3779B97F4A7C15) + sums[:, cell])
            found.append(signature)
            empty.append(held[:, kept].sum(1) == 0)
    owner = np.repeat(which, parts)
    empty_parts = np.add.reduceat(np.logical_or.reduce(empty).astype(np.int64), row)
    over = (spare >= 0) & (empty_parts > spare)
    last = level == LEVELS - 1
    whole = np.repeat((spare < 0) | (over & last), parts)  # these send empty ones too
    send = [~e | whole for e in empty]
    again = [] if last else [j for j, o in zip(jobs, over.tolist(), strict=True) if o]
    return [f[s] for f, s in zip(found, send, strict=True)], [owner[s] for s in send], again


def signatures_of(sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """PartEnum signatures of non-empty sorted sets of 64-bit features, and the set that each is of.

    The feature domain is cut into parts, each of cells pieces. Two sets of one band that differ in at most
    distance features differ by more than `loose` in fewer parts than there are, so in some part
    cells - loose of its pieces agree: every subset of so many pieces of a part makes one signature.

    A signature of empty pieces would bring together sets that have nothing in common. A similar pair
    agrees in spare + 1 parts at least; a set with at most spare parts of empty pieces therefore leaves those
    signatures out. Where both sets of a pair have more such parts, both are signed again on the next
    level, under another hash of the features; on the last level, and in bands of small sets, empty
    pieces are signed as well. So no similar pair is lost.
    """
    if not sets:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    size = np.array([len(s) for s in sets], np.int64)
    ladder = bands(percent, 1 << max(10, int(size.max()).bit_length() + 1))
    at = np.searchsorted(np.array([b.high for b in ladder]), size)
    left = []
    for i, (b, n) in enumerate(zip(at.tolist(), size.tolist(), strict=True)):
        left.append((i, ladder[b]))
        if 100 * n // percent > ladder[b].high:  # a partner may lie in the next band
            left.append((i, ladder[b + 1]))
    codes, owners = [], []
    for level in range(LEVELS):
        if level:
            chosen = sorted({i for i, _ in left})
            place = {i: k for k, i in enumerate(chosen)}
            with np.errstate(over="ignore"):
                held = [np.sort(mix(sets[i] + np.uint64(level) * np.uint64(0xD6E8FEB86659FD93))) for i in chosen]
        else:
            chosen, held = list(range(len(sets))), sets
            place = {i: i for i in chosen}
        flat = np.concatenate(held)
        sizes = np.array([len(s) for s in held], np.int64)
        start = np.cumsum(sizes) - sizes
        names = np.array(chosen, np.int64)
        groups: dict[tuple[int, int], list[tuple[int, Band]]] = {}
        for i, band in left:
            groups.setdefault((band.cells, band.loose), []).append((place[i], band))
        left = []
        for jobs in groups.values():
            code, owner, again = _signed(flat, start, sizes, jobs, level)
            codes += code
            owners += [names[o] for o in owner]
            left += [(chosen[k], band) for k, band in again]
        if not left:
            break
    return np.concatenate(codes), np.concatenate(owners)


def signatures(features: np.ndarray, percent: int) -> np.ndarray:
    """PartEnum signatures of one sorted set of 64-bit features."""
    return signatures_of([features], percent)[0]


def sketch(features: np.ndarray, percent: int, fineness: int = 4) -> bytes:
    """Four bits for each of a power of two of pieces of the domain.

    Differing bits prove a differing feature, and two where the lowest bit agrees, as the counts' parity does.
    """
    pieces = 1 << max(4, (fineness * most_distance(len(features), percent)).bit_length())
    place = (features >> np.uint64(64 - (pieces.bit_length() - 1))).astype(np.int64)
    held = np.bincount(place, minlength=pieces)
    with np.errstate(over="ignore"):
        # Every feature adds an odd number, so a sum's lowest bit is the parity of their count.
        total = np.r_[np.uint64(0), np.cumsum(mix(features ^ np.uint64(0xA5A5A5A5A5A5A5A5)) | np.uint64(1))]
        end = np.cumsum(held)
        sums = total[end] - total[end - held]
    # Low bits of sums: adding two pieces' bits gives those of the piece that both make up.
    bits = (sums & np.uint64(15)).astype(np.uint8)
    return (bits[0::2] | (bits[1::2] << 4)).tobytes()


def _unpacked(data: list[bytes]) -> np.ndarray:
    """Sketches as rows of one length, the shortest's."""
    shortest = min(map(len, data))
    rows = np.zeros((len(data), 2 * shortest), np.uint8)
    for i, d in enumerate(data):
        x = np.frombuffer(d, np.uint8)
        x = np.stack([x & 15, x >> 4], 1).reshape(-1)
        while len(x) > 2 * shortest:
            x = (x[0::2] + x[1::2]) & 15
        rows[i] = x
    return rows


def sketches_allow(a: bytes, n_a: int, b: bytes, n_b: int, percent: int) -> bool:
    """Whether two sets may reach the similarity; never False for a pair that does."""
    if 100 * min(n_a, n_b) < percent * max(n_a, n_b):
        return False
    x, y = _unpacked([a, b])
    differ = x ^ y
    return 2 * np.count_nonzero(differ) - np.count_nonzero(differ & 1) <= pair_distance(n_a, n_b, percent)


class Sketches:
    """The sketches of a block's sets, 16 pieces a number, and their sizes."""

    def __init__(self, data: list[bytes], n: np.ndarray, percent: int):
        rows = _unpacked(data)
        self.rows = np.ascontiguousarray(rows[:, 0::2] | (rows[:, 1::2] << 4)).view(np.uint64)
        self.n, self.percent = n, percent

    def near(self, i: int, others: np.ndarray) -> np.ndarray:
        """Those of the others that may be similar to set i."""
        n, low = self.n, np.uint64(0x1111111111111111)
        others = others[100 * np.minimum(n[others], n[i]) >= self.percent * np.maximum(n[others], n[i])]
        if not len(others):
            return others
        differ = self.rows[others] ^ self.rows[i]
        odd = np.bitwise_count(differ & low).sum(1, dtype=np.int64)
        differ |= differ >> np.uint64(1)
        differ |= differ >> np.uint64(2)
        pieces = np.bitwise_count(differ & low).sum(1, dtype=np.int64)
        return others[2 * pieces - odd <= pair_distance(n[others], n[i], self.percent)]


def block_pairs(sketches: Sketches, group: np.ndarray, side: np.ndarray, forests: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of a block's pairs of different groups that sketches allow.

    side is 0 everywhere to compare all with all, else only 1 with 2. With forests, only as many pairs as
    that number of spanning forests of the graph of groups and allowed pairs hold: a bound in proportion to
    the block, and enough to join all groups of which the pairs turn out similar.
    """
    left, right = [], []
    _, group = np.unique(group, return_inverse=True)
    trees = [group.copy() for _ in range(forests or 0)]
    every = np.arange(len(group))
    second = np.flatnonzero(side == 2)
    for i in np.flatnonzero(side != 2).tolist():
        later = every[i + 1 :] if side[i] == 0 else second
        later = later[group[later] != group[i]]
        if trees:  # nothing to add where all trees hold both
            later = later[np.logical_or.reduce([t[later] != t[i] for t in trees])]
        near = sketches.near(i, later) if len(later) else later
        for tree in trees:
            if not len(near):
                break
            fresh = np.flatnonzero(tree[near] != tree[i])
            names, first = np.unique(tree[near[fresh]], return_index=True)
            if len(first):
                chosen = fresh[first]
                left += [i] * len(chosen)
                right.append(near[chosen])
                tree[np.isin(tree, names)] = tree[i]
                near = np.delete(near, chosen)
        if not trees and len(near):
            left += [i] * len(near)
            right.append(near)
    return np.array(left, np.int64), np.concatenate(right) if right else np.zeros(0, np.int64)


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, of two sorted distinct arrays."""
    if not len(a) or not len(b):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)
