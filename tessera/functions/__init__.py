"""Column functions for types without SQL spelling: vectors, boxes, JSON keys, timestamps, extracted keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def squared_l2(a: Column, b: Column) -> Column:
    """Squared distance of two float vectors, in doubles; different lengths are an error."""
    gap = lambda x, y: x.cast("double") - y.cast("double")
    total = F.aggregate(F.zip_with(a, b, lambda x, y: gap(x, y) * gap(x, y)), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), total).otherwise(F.raise_error(F.lit("type: vectors differ in length")))


def box(min_x: Column, min_y: Column, max_x: Column, max_y: Column) -> Column:
    """A bounding box; its corners must be in order."""
    made = F.struct(min_x.alias("min_x"), min_y.alias("min_y"), max_x.alias("max_x"), max_y.alias("max_y"))
    return F.when((min_x <= max_x) & (min_y <= max_y), made).otherwise(F.raise_error(F.lit("type: a box's corners are out of order")))


def overlaps(a: Column, b: Column) -> Column:
    """Whether two boxes share a point; touching counts."""
    return (a["min_x"] <= b["max_x"]) & (b["min_x"] <= a["max_x"]) & (a["min_y"] <= b["max_y"]) & (b["min_y"] <= a["max_y"])


def timestamp_delta_us(a: Column, b: Column) -> Column:
    """a - b in microseconds."""
    return F.unix_micros(a.cast("timestamp")) - F.unix_micros(b.cast("timestamp"))


def json_path(pointer: str) -> str:
    """The JSON path of an RFC 6901 pointer."""
    if pointer and not pointer.startswith("/"):
        raise ValueError("a pointer is empty or starts with /")
    parts = [p.replace("~1", "/").replace("~0", "~") for p in pointer.split("/")[1:]]
    return "$" + "".join(f"[{p}]" if p.isdigit() else f"['{p}']" for p in parts)


def json_key(document: Column, pointer: str, kind: str) -> Column:
    """The text, int or real at a pointer; null where it is missing, null or of another kind."""
    found = F.try_variant_get(F.try_parse_json(document), json_path(pointer), "variant")
    named = F.schema_of_variant(found)
    wanted = {"text": named == "STRING", "int": named == "BIGINT", "real": (named == "DOUBLE") | named.startswith("DECIMAL")}[kind]
    return F.when(wanted, F.try_variant_get(found, "$", {"text": "string", "int": "bigint", "real": "double"}[kind]))


def contains(keys: Column, key: object) -> Column:
    """Whether an extracted key, or array of keys, has this one; a missing key is false, not unknown."""
    return F.coalesce(keys == F.lit(key), F.lit(False))


def contains_any(keys: Column, key: object) -> Column:
    """contains() for an extractor that gives an array of keys."""
    return F.coalesce(F.array_contains(keys, F.lit(key)), F.lit(False))
