"""Operator 5, secret scans: base patterns and a randomness test battery under false-discovery control."""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tessera.llm.common import lean, read_documents, slices, texts_of

# The base patterns and their least lengths.
ASSIGN = re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_LEAST, ACCESS_LEAST = 6, 20
KINDS = ("assign", "access", "hex", "random")
_ASSIGN_HINTS = ("passw", "secret", "token", "api")

CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
_UPPER, _LOWER, _DIGIT = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: Encodings from the narrowest alphabet to the widest, in code order.
ENCODINGS = (
    ("hex", _DIGIT + "abcdef"),
    ("hex_upper", _DIGIT + "ABCDEF"),
    ("base32", _UPPER + "234567"),
    ("upper_digit", _UPPER + _DIGIT),
    ("lower_digit", _LOWER + _DIGIT),
    ("base64", _UPPER + _LOWER + _DIGIT + "+/"),
    ("base64url", _UPPER + _LOWER + _DIGIT + "-_"),
    ("mixed", _UPPER + _LOWER + _DIGIT + "+/-_"),
)
_CODES = tuple((name, {c: i for i, c in enumerate(alphabet)}) for name, alphabet in ENCODINGS)
#: How often two letters of ordinary words agree, and how often the character class changes in identifiers.
PROSE_COINCIDENCE, PROSE_CHANGES = 0.065, 0.12


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base patterns, leftmost and non-overlapping per kind, in span order."""
    found = []
    low = text.lower()
    if any(hint in low for hint in _ASSIGN_HINTS):
        found += [(*m.span(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [(*m.span(), 1) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_LEAST]
    found += [(*m.span(), 2) for m in HEX.finditer(text)]
    return [(start, end, KINDS[kind]) for start, end, kind in sorted(found, key=lambda x: (x[0], x[2]))]


def infer_encoding(value: str) -> tuple[str, list[int], int]:
    """The narrowest encoding whose alphabet holds the value: name, codes, alphabet size."""
    letters = set(value)
    for name, codes in _CODES:
        if letters <= codes.keys():
            return name, [codes[c] for c in value], len(codes)
    raise ValueError(value)


def _upper_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def _fisher(*p: float) -> float:
    """One p-value from independent ones (the chi-squared tail with an even number of degrees of freedom)."""
    half = -sum(math.log(max(x, 1e-300)) for x in p)
    term = total = 1.0
    for i in range(1, len(p)):
        term *= half / i
        total += term
    return min(1.0, math.exp(-half) * total)


def battery(codes: list[int], size: int) -> dict[str, float]:
    """p-values of the tests against uniform random codes: alphabet uniformity, runs, serial correlation."""
    n = len(codes)
    expected = n / size
    chi = sum(c * c for c in Counter(codes).values()) / expected - n
    # Exact moments of the statistic under uniform codes; short values make the usual approximation poor.
    mean, variance = size - 1, 2 * (size - 1) * (n - 1) / n
    uniform = _upper_tail((chi - mean) / math.sqrt(variance))
    high = [2 * c >= size for c in codes]
    ups = sum(high)
    runs = 1 + sum(a != b for a, b in zip(high, high[1:], strict=False))
    if 0 < ups < n:
        mu = 1 + 2 * ups * (n - ups) / n
        var = max((mu - 1) * (mu - 2) / max(n - 1, 1), 1e-9)
        runs_p = math.erfc(abs(runs - mu) / math.sqrt(2 * var))
    else:
        runs_p = 2.0 ** (1 - n)
    centre = sum(codes) / n
    around = [c - centre for c in codes]
    power = sum(a * a for a in around)
    serial = sum(a * b for a, b in zip(around, around[1:], strict=False)) / power if power else 1.0
    serial_p = math.erfc(abs(serial + 1 / n) * math.sqrt(n) / math.sqrt(2))
    return {"uniform": uniform, "runs": runs_p, "serial": serial_p, "chi": chi}


def prose_p(value: str, codes: list[int], size: int, chi: float) -> float:
    """p-value against ordinary words and identifiers, which repeat letters and keep to one class.

    Small where the value is far more even than words of its length are, and changes between capitals,
    small letters and digits far more often.
    """
    n = len(codes)
    excess = max(PROSE_COINCIDENCE * size - 1, 0.25)
    mean = size - 1 + (n - 1) * excess
    spread = math.sqrt(2 * (size - 1) + 4 * (n - 1) * excess * (1 + excess))
    even = _upper_tail((mean - chi) / spread)
    kinds = ["U" if c.isupper() else "l" if c.islower() else "d" if c.isdigit() else "-" for c in value]
    changes = sum(a != b for a, b in zip(kinds, kinds[1:], strict=False))
    mu = (n - 1) * PROSE_CHANGES
    changing = _upper_tail((changes - 0.5 - mu) / math.sqrt(mu * (1 - PROSE_CHANGES)))
    return _fisher(even, changing)


def random_spans(text: str, taken: list[tuple[int, int, str]], false_rate: float = 1e-3, least_random: float = 1e-3) -> list[tuple[int, int, str]]:
    """Spans that the battery takes for random keys.

    A candidate must pass the battery (its combined p-value under randomness is least_random or more) and
    stand out from ordinary words; the latter p-values of all of a text's candidates go through a weighted
    Benjamini-Hochberg step, each weighted by its length over the mean length, so a long text's many
    chances and short values' weak evidence are both paid for.
    """
    tested = []
    starts = [a for a, _, _ in taken]  # in span order
    furthest = list(accumulate((b for _, b, _ in taken), max))
    for m in CANDIDATE.finditer(text):
        start, end = m.span()
        before = bisect_right(starts, start)
        if before and furthest[before - 1] >= end:
            continue
        value = m[0].rstrip("=")
        _, codes, size = infer_encoding(value)
        found = battery(codes, size)
        tested.append((start, end, prose_p(value, codes, size, found["chi"]), _fisher(found["uniform"], found["runs"], found["serial"])))
    if not tested:
        return []
    mean = sum(end - start for start, end, _, _ in tested) / len(tested)
    ranked = sorted((p * mean / (end - start), start, end, fits) for start, end, p, fits in tested)
    last = max((i for i, x in enumerate(ranked, 1) if x[0] <= false_rate * i / len(ranked)), default=0)
    return [(start, end, "random") for _, start, end, fits in ranked[:last] if fits >= least_random]


def find_secrets(text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Base spans, and all spans, both by start and then kind."""
    base = base_spans(text)
    extra = random_spans(text, base)
    return base, sorted(base + extra, key=lambda x: (x[0], KINDS.index(x[2]))) if extra else base


def spans_text(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def redact(text: str, spans: list[tuple[int, int, str]], mark: str = "[SECRET]") -> str:
    """The text with every span, or run of overlapping spans, replaced by mark."""
    out, at = [], 0
    for start, end, _ in spans:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def secret_scan(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", redacted: bool = False) -> DataFrame:
    """Secrets of each whole text: id, n_assign, n_access, n_hex, n_random, base_sha256, spans[, redacted].

    Spans are code points, end exclusive. A null text counts as empty (no spans; its redacted form stays
    null); each row is scanned for itself, so ties, repeats and null ids don't matter; an empty table gives
    no rows; other columns are not read. One narrow pass without a shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            rows = []
            for text in texts_of(part, "text"):
                base, spans = find_secrets(text)
                counts = Counter(kind for _, _, kind in spans)
                rows.append((*(counts[k] for k in KINDS), hashlib.sha256(spans_text(base).encode()).hexdigest(), spans_text(spans), *[redact(text, spans) if spans else text] * redacted))
            kinds = [*[pa.int64()] * 4, pa.string(), pa.string(), *[pa.string()] * redacted]
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("id"), *columns], names=[id_column, *names])

    names = ["n_assign", "n_access", "n_hex", "n_random", "base_sha256", "spans", *["redacted"] * redacted]
    kind = docs.schema[id_column].dataType.simpleString()
    schema = f"`{id_column}` {kind}, n_assign bigint, n_access bigint, n_hex bigint, n_random bigint, base_sha256 string, spans string" + ", redacted string" * redacted
    return docs.select(docs[id_column].alias("id"), docs[text_column].alias("text")).mapInArrow(lean(run), schema)


def redacted_documents(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """The same rows and columns, with the secrets in the texts replaced; null texts stay null."""
    at = docs.columns.index(text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text_column):
            texts = [None if t is None else redact(t, spans) if (spans := find_secrets(t)[1]) else t for t in part.column(at).to_pylist()]
            yield part.set_column(at, part.schema.field(at).with_nullable(True), pa.array(texts, part.schema.field(at).type))

    return docs.mapInArrow(lean(run), docs.schema)


def op5_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(read_documents(spark, sf_dir))
