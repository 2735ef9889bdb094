"""Byte-level BPE: pre-tokens, exact ids, and token counts by rank-synchronous array merging."""

from __future__ import annotations

import base64
import json
import os
import re
from functools import lru_cache

import numpy as np

from tessera.llm.common import tokenizer_file

# Fixed value: the pattern that splits text before the merges, here for texts of the characters below alone.
_LETTER = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
_NUMBER = "0-9²³¹¼-¾"
_PLAIN_SPLIT = re.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[{_NUMBER}]+| ?[^ \t\n\r{_LETTER}{_NUMBER}]+|[ \t\n\r]+(?![^ \t\n\r])|[ \t\n\r]+"
)
# Characters whose classes every library agrees on; other texts are split by the tokenizer's own splitter.
_UNUSUAL = re.compile("[^\t\n\r\x20-\x7e\xa1-ɏ]")
_SPECIAL = "<|endoftext|>"
_NONE = np.int32(2**31 - 1)


def is_plain(text: str) -> bool:
    """Whether the quick splitter is known to agree with the tokenizer on this text."""
    return _UNUSUAL.search(text) is None and _SPECIAL not in text


@lru_cache(maxsize=2)
def library(name: str = "byte_bpe_50k.json"):
    """The tokenizers library's tokenizer of this file."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_file(name))


@lru_cache(maxsize=1)
def _quick(name: str):
    import public_tokenizers
    import tiktoken

    with open(tokenizer_file(name), "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def encode(text: str, name: str = "byte_bpe_50k.json") -> list[int]:
    """The ids that the tokenizers library gives, without added special tokens.

    Plain texts go through the same vocabulary as ranks, several times faster; all others through the
    library itself. tests/llm holds the two against each other.
    """
    ranks = name.removesuffix(".json") + ".tiktoken"
    if is_plain(text) and os.path.exists(tokenizer_file(ranks)):
        return _quick(ranks).encode_ordinary(text)
    return library(name).encode(text, add_special_tokens=False).ids


def _byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class MergeTable:
    """Merge ranks as sorted arrays: (left id, right id) to rank and merged id."""

    def __init__(self, name: str = "byte_bpe_50k.json"):
        with open(tokenizer_file(name), encoding="utf-8") as file:
            spec = json.load(file)
        vocabulary, merges = spec["model"]["vocab"], spec["model"]["merges"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        left = np.array([vocabulary[a] for a, _ in pairs], np.uint64)
        right = np.array([vocabulary[b] for _, b in pairs], np.uint64)
        keys = (left << np.uint64(32)) | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank = keys[order], order.astype(np.int32)
        self.merged = np.array([vocabulary[a + b] for a, b in pairs], np.int32)
        self.of_byte = np.array([vocabulary[c] for c in _byte_alphabet()], np.int32)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merge rank of each pair; the largest int where the pair never merges."""
        keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.rank[at], _NONE)


@lru_cache(maxsize=2)
def merge_table(name: str = "byte_bpe_50k.json") -> MergeTable:
    return MergeTable(name)


def count_symbols(pieces: list[bytes], table: MergeTable) -> np.ndarray:
    """Tokens of each pre-token.

    All pre-tokens lie in one ragged array. Each round finds every sequence's lowest-rank pair, merges all
    its occurrences (left to right, not overlapping) in all sequences at once, and drops the sequences in
    which no pair merges any more. Empty pieces count 0.
    """
    lengths = np.array([len(p) for p in pieces], np.int64)
    counts = lengths.copy()
    symbols = table.of_byte[np.frombuffer(b"".join(pieces), np.uint8)]
    owner = np.repeat(np.arange(len(pieces)), lengths)
    if len(symbols) == 0:
        return counts
    rank = np.full(len(symbols), _NONE, np.int32)
    inner = np.flatnonzero(owner[1:] == owner[:-1])
    rank[inner] = table.ranks(symbols[inner], symbols[inner + 1])
    while len(symbols):
        starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        sizes = np.diff(np.r_[starts, len(owner)])
        lowest = np.minimum.reduceat(rank, starts)
        live = lowest != _NONE
        counts[owner[starts[~live]]] = sizes[~live]
        if not live.any():
            break
        if not live.all():
            stay = np.repeat(live, sizes)
            symbols, owner, rank = symbols[stay], owner[stay], rank[stay]
            lowest, sizes = lowest[live], sizes[live]
        chosen = np.flatnonzero(rank == np.repeat(lowest, sizes))
        # Neighbouring candidates overlap (as in aaa): of each run every second one stands.
        breaks = np.r_[True, np.diff(chosen) != 1]
        run_start = chosen[breaks][np.cumsum(breaks) - 1]
        chosen = chosen[(chosen - run_start) % 2 == 0]
        symbols[chosen] = table.merged[rank[chosen]]
        keep = np.ones(len(symbols), bool)
        keep[chosen + 1] = False
        moved = np.cumsum(keep) - 1
        symbols, owner, rank = symbols[keep], owner[keep], rank[keep]
        at = moved[chosen]
        again = np.unique(np.r_[at, at[at > 0] - 1])
        inside = again[again + 1 < len(symbols)]
        same = owner[inside] == owner[inside + 1]
        rank[again] = _NONE
        rank[inside[same]] = table.ranks(symbols[inside[same]], symbols[inside[same] + 1])
    return counts


def split_pretokens(text: str, name: str = "byte_bpe_50k.json") -> tuple[list[bytes], int]:
    """Pre-tokens as bytes, and how often the special token's string stands in the text."""
    if is_plain(text):
        return [p.encode() for p in _PLAIN_SPLIT.findall(text)], 0
    parts = text.split(_SPECIAL)
    splitter = library(name).pre_tokenizer
    back = {c: b for b, c in enumerate(_byte_alphabet())}
    pieces = [bytes(back[c] for c in piece) for part in parts if part for piece, _ in splitter.pre_tokenize_str(part)]
    return pieces, len(parts) - 1


class Counter:
    """Token counts of texts; remembers the counts of up to most_held pre-tokens."""

    def __init__(self, name: str = "byte_bpe_50k.json", most_held: int = 250_000):
        self.name, self.table, self.most_held = name, merge_table(name), most_held
        self.held: dict = {}

    def count(self, texts: list[str]) -> list[int]:
        held, split, extra, fresh = self.held, [], [], set()
        for text in texts:
            if is_plain(text):
                pieces, special = _PLAIN_SPLIT.findall(text), 0
            else:
                pieces, special = split_pretokens(text, self.name)
            split.append(pieces)
            extra.append(special)
            fresh.update(pieces)
        fresh.difference_update(held)
        fresh_list = list(fresh)
        for start in range(0, len(fresh_list), 50_000):
            some = fresh_list[start : start + 50_000]
            found = count_symbols([p if isinstance(p, bytes) else p.encode() for p in some], self.table)
            held.update(zip(some, found.tolist(), strict=True))
        out = [sum(map(held.__getitem__, pieces)) + special for pieces, special in zip(split, extra, strict=True)]
        if len(held) > self.most_held:
            held.clear()
        return out
