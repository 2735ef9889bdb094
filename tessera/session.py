"""Sessions: named tables over Spark, and SQL in the dialect."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Iterator
from itertools import islice
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.errors import EngineError
from tessera.plans.lowering import Lowering, kind_of
from tessera.plans.syntax import parse_query
from tessera.plans.types import Extractor, UserType
from tessera.sources.shared import row_group_rows


#: The names of the dialect's own types.
BUILT_IN = ("integer", "int", "bigint", "real", "numeric", "text", "varchar", "date", "decimal", "blob", "vector")


class Session:
    """Runs the dialect's queries over DataFrames that are registered as tables."""

    def __init__(self, spark: SparkSession):
        self.spark, self._id = spark, uuid.uuid4().hex[:12]
        self._tables: dict[str, tuple[str, T.StructType]] = {}
        self._functions: dict[str, Any] = {}
        self._lowered: dict[tuple, str] = {}
        self._rowids: dict[str, str] = {}
        self._types: dict[str, UserType] = {}
        self._typed: dict[str, dict[str, str]] = {}
        self._extractors: dict[str, Extractor] = {}
        self._places: dict[str, tuple[str, ...]] = {}
        self._files: dict[str, list[str]] = {}
        self._row_groups: dict[str, int] = {}

    def register(self, name: str, df: DataFrame, rowid: str | None = None, types: dict[str, str] | None = None, ordered: bool = False) -> None:
        """Make a DataFrame a table; names are lower-cased. rowid names its integer primary key, if it has one.

        types names the columns that hold stored values of a user type. ordered: the DataFrame reads Parquet files as they are,
        and sums of its reals add in the order of the rows there where they can (hidden columns hold their places).
        """
        typed = {column.lower(): own.lower() for column, own in (types or {}).items()}
        for column, own in typed.items():
            if own not in self._types or column not in {c.lower() for c in df.columns}:
                raise EngineError("schema", f"no type {own} or no column {column}")
        self._typed[name.lower()] = typed
        self._rowids.pop(name.lower(), None)
        if rowid:
            self._rowids[name.lower()] = rowid.lower()
        view, schema = f"tessera_{self._id}_{name.lower()}", df.schema
        self._places.pop(name.lower(), None)
        self._row_groups.pop(name.lower(), None)
        if ordered:
            self._files[name.lower()] = df.inputFiles()
            held = {"tessera_row": "row_index"} if len(self._files[name.lower()]) == 1 else {"tessera_file": "file_path", "tessera_row": "row_index"}
            df = df.select("*", *(F.col(f"_metadata.{column}").alias(hidden) for hidden, column in held.items()))
            self._places[name.lower()] = tuple(held)
        df.createOrReplaceTempView(view)
        self._tables[name.lower()] = (f"`{view}`", schema)
        self._lowered.clear()

    def drop(self, name: str) -> None:
        if self._tables.pop(name.lower(), None) is None:
            raise EngineError("schema", f"no table {name}")
        self.spark.catalog.dropTempView(f"tessera_{self._id}_{name.lower()}")

    def tables(self) -> list[str]:
        return sorted(self._tables)

    def function(self, name: str, function: Callable, returns: T.DataType) -> None:
        """Register a scalar or aggregate function (a pandas or Arrow UDF, or a Python callable) for this session's SQL."""
        physical = f"tessera_{self._id}_{name.lower()}"  # Spark's registry is shared by all sessions
        self.spark.udf.register(physical, function) if hasattr(function, "returnType") else self.spark.udf.register(physical, function, returns)
        self._functions[name.lower()] = (physical, kind_of(returns))
        self._lowered.clear()

    def type(self, own: UserType) -> None:
        """Add a type: CAST(x AS name), name 'text' and columns registered with it. A name that is taken is an error."""
        if own.name.lower() in self._types or own.name.lower() in BUILT_IN or own.name != own.name.lower():
            raise EngineError("schema", f"the type name {own.name} is taken or not in lower case")
        self._types[own.name] = own
        self._lowered.clear()

    def extractor(self, own: Extractor) -> None:
        """Add a key extractor: contains(value, 'name', key) in SQL."""
        self._extractors[own.name] = own
        self._lowered.clear()

    def row_groups(self, name: str) -> int:
        """The rows of a row group in the files of an ordered table; 0 if each has one only or they are not of one size.

        The driver reads the footer of each file once, and only for queries whose sums depend on it.
        """
        if name not in self._row_groups:
            self._row_groups[name] = row_group_rows(self.spark, self._files[name])
        return self._row_groups[name]

    def lower(self, text: str, params: Any = None) -> str:
        """The Spark SQL that a query becomes; remembered for the same text and parameters."""
        key = (text, repr(params))
        if key not in self._lowered:
            if len(self._lowered) >= 256:
                self._lowered.clear()
            self._lowered[key] = Lowering(self._tables.get, params, self._functions, self._rowids, self._types, self._typed, self._extractors, self._places, self.row_groups).query(parse_query(text))[0]
        return self._lowered[key]

    def sql(self, text: str, params: Any = None) -> DataFrame:
        """Run a query; params is a list for ? and ?N, or a dict for :name, @name and $name."""
        return self.spark.sql(self.lower(text, params))

    def collect(self, text: str, params: Any = None, seconds: float | None = None, tag: str | None = None) -> list[Row]:
        """All rows; the query is cancelled after so many seconds, or by cancel(tag) from another thread."""
        tag = tag or f"tessera-{uuid.uuid4().hex}"
        done, late = threading.Event(), threading.Event()

        def watch() -> None:
            if not done.wait(seconds):
                late.set()
                while not done.wait(0.2):  # again for jobs that had not started
                    self.cancel(tag)

        self.spark.sparkContext.addJobTag(tag)
        try:
            if seconds is not None:
                threading.Thread(target=watch, daemon=True).start()
            return self.sql(text, params).collect()
        except Exception as error:
            if late.is_set() or "cancelled" in str(error).lower():
                raise EngineError("cancelled", "the deadline passed" if late.is_set() else "the query was cancelled") from error
            raise
        finally:
            done.set()
            self.spark.sparkContext.removeJobTag(tag)

    def cancel(self, tag: str) -> None:
        """Cancel the queries that run under a tag."""
        self.spark.sparkContext.cancelJobsWithTag(tag)

    def each(self, text: str, visit: Callable[[Row], Any], params: Any = None) -> int:
        """Call visit on each row as partitions arrive, until it returns False; returns rows visited."""
        n = 0
        for row in self.cursor(text, params):
            n += 1
            if visit(row) is False:
                break
        return n

    def cursor(self, text: str, params: Any = None) -> Cursor:
        """Rows one after another, a partition at a time on the driver."""
        return Cursor(self.sql(text, params))


class Cursor:
    """Rows of a query in order: iterate, or fetch so many at a time; close ends it."""

    def __init__(self, df: DataFrame):
        self.columns = df.columns
        self._rows: Iterator[Row] | None = df.toLocalIterator(prefetchPartitions=True)

    def __iter__(self) -> Iterator[Row]:
        return self

    def __next__(self) -> Row:
        if self._rows is None:
            raise EngineError("state", "the cursor is closed")
        return next(self._rows)

    def fetch(self, n: int) -> list[Row]:
        """The next n rows, fewer at the end."""
        return list(islice(self, n))

    def close(self) -> None:
        self._rows = None
