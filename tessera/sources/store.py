"""A snapshot store over immutable Parquet: DDL, DML, constraints, transactions, savepoints.

A table version is a Parquet folder that never changes; a manifest names each table's folder and rules.
Writers stage new folders and commit by creating the next manifest, which fails if another writer was
first. Readers keep the manifest that they opened.
"""

from __future__ import annotations

import json
import uuid
from copy import deepcopy
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.errors import EngineError
from tessera.plans.lowering import Lowering, Scope, Source, kind_of, quoted, type_sql
from tessera.plans.syntax import Parser, Query, Select, statements
from tessera.session import Session

#: Bytes of Parquet that VACUUM puts into one file, about.
COMPACT_BYTES = 128 << 20
_KINDS = {"integer": "int", "int": "int", "bigint": "int", "real": "real", "text": "text", "varchar": "text", "date": "date", "blob": "blob", "vector": "vector"}


def _spark_type(name: str, numbers: tuple[int, ...]) -> str:
    if name == "decimal":
        precision, scale = (*numbers, 0)[:2] if numbers else (18, 3)
        return f"DECIMAL({precision},{scale})"
    if name not in _KINDS:
        raise EngineError("type", f"no type {name}")
    return type_sql(_KINDS[name])


class Store:
    """Tables under a root folder, with SQL statements on them.

    Statements outside a transaction commit by themselves. Rows of INSERT ... VALUES are few and pass through
    the driver; all else is DataFrames. A table that a statement changes is written anew (its unchanged
    files are read once), so batch small writes.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(f"{self.root}/manifests"))
        self._base = self._latest()
        self._tables: dict[str, dict] = self._load(self._base)
        self._open = False
        self._savepoints: list[tuple[str, dict]] = []

    # -- manifests
    def _latest(self) -> int:
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.root}/manifests"))]
        return max((int(n.removesuffix(".json")) for n in names if n.endswith(".json")), default=0)

    def _load(self, version: int) -> dict[str, dict]:
        if not version:
            return {}
        stream = self._fs.open(self._path(f"{self.root}/manifests/{version}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _commit(self) -> None:
        """Write the manifest aside and rename it, without overwriting, to the next number: it is there whole or not at all."""
        folder = f"{self.root}/manifests"
        target, aside = self._path(f"{folder}/{self._base + 1}.json"), self._path(f"{folder}/.{uuid.uuid4().hex}.new")
        stream = self._fs.create(aside, False)
        stream.write(bytearray(json.dumps(self._tables).encode()))
        stream.close()
        sc = self.spark.sparkContext
        files = sc._jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), sc._jsc.hadoopConfiguration())
        try:
            files.rename(aside, target, sc._gateway.new_array(getattr(sc._jvm.org.apache.hadoop.fs, "Options$Rename"), 0))
        except Exception as error:
            self._fs.delete(aside, False)
            self._tables = self._load(self._base)
            raise EngineError("conflict", "another writer committed first") from error
        self._base += 1

    def snapshot(self) -> Session:
        """A session on the tables as they are now; later commits don't change it."""
        own = Session(self.spark)
        for name, table in self._tables.items():
            own.register(name, self.frame(name), self._integer_key(table))
        return own

    @staticmethod
    def _integer_key(table: dict) -> str | None:
        """The integer primary key, which rowid also names."""
        kinds = {c["name"]: c["type"] for c in table["columns"]}
        return table["primary"][0] if len(table["primary"]) == 1 and kinds[table["primary"][0]] == "BIGINT" else None

    def refresh(self) -> None:
        """Read the latest commit (outside a transaction)."""
        if self._open:
            raise EngineError("state", "a transaction is open")
        self._base = self._latest()
        self._tables = self._load(self._base)

    # -- tables
    def _table(self, name: str) -> dict:
        if name not in self._tables:
            raise EngineError("schema", f"no table {name}")
        return self._tables[name]

    def _schema(self, table: dict) -> T.StructType:
        return T.StructType([T.StructField(c["name"], T._parse_datatype_string(c["type"])) for c in table["columns"]])

    def frame(self, name: str) -> DataFrame:
        table = self._table(name)
        schema = self._schema(table)
        if not table["path"]:
            return self.spark.createDataFrame([], schema)
        stored = self.spark.read.schema(schema).parquet(*self._folders(table))
        return stored.select(*(F.col(c.name).cast(c.dataType) for c in schema))

    @staticmethod
    def _folders(table: dict) -> list[str]:
        """The folders that make up a table: one, or more after rows were appended."""
        return table["path"] if isinstance(table["path"], list) else [table["path"]] if table["path"] else []

    def _write(self, name: str, rows: DataFrame) -> None:
        """Check the new rows of a table and make them its version. Rows lie in the order of the table's first index."""
        table = self._table(name)
        path = f"{self.root}/tables/{name}/{uuid.uuid4().hex}"
        self._ordered(table, rows).write.parquet(path)
        before = table["path"]
        table["path"] = path
        try:
            self._check(name)
        except EngineError:
            table["path"] = before
            raise

    def _append(self, name: str, fresh: DataFrame) -> None:
        """Add rows as a folder of their own, which alone is checked (keys and references by joins on these rows)."""
        table = self._table(name)
        path = f"{self.root}/tables/{name}/{uuid.uuid4().hex}"
        self._ordered(table, fresh).write.parquet(path)
        before = table["path"]
        rows = self.spark.read.schema(self._schema(table)).parquet(path)
        try:
            self._check_rows(table, rows)
            for key in table["keys"]:
                whole = rows.where(" AND ".join(f"{quoted(c)} IS NOT NULL" for c in key))
                if not whole.groupBy(*key).count().where("count > 1").isEmpty() or not whole.join(self.frame(name).select(*key), key, "left_semi").isEmpty():
                    raise EngineError("constraint", f"{', '.join(key)} is not unique")
            table["path"] = [*self._folders(table), path]
            for columns, target, target_columns in table["references"]:
                self._check_reference(name, rows, columns, target, target_columns)
        except EngineError:
            table["path"] = before
            raise

    @staticmethod
    def _ordered(table: dict, rows: DataFrame) -> DataFrame:
        """Rows of each file sorted by the table's first index or primary key, so that scans can skip by it."""
        columns = next(iter(table["indexes"].values()), None) or [[c, False] for c in table["primary"]]
        keys = [F.col(c).desc() if down else F.col(c).asc() for c, down in columns]
        return rows.sortWithinPartitions(*keys) if keys else rows

    def _check_reference(self, name: str, rows: DataFrame, columns: list[str], target: str, target_columns: list[str]) -> None:
        mine = rows.select(*(F.col(c).alias(f"c{i}") for i, c in enumerate(columns))).dropna().distinct()
        theirs = self.frame(target).select(*(F.col(c).alias(f"c{i}") for i, c in enumerate(target_columns)))
        if not mine.join(theirs, [f"c{i}" for i in range(len(columns))], "left_anti").isEmpty():
            raise EngineError("constraint", f"{name} refers to rows that {target} lacks")

    def _check(self, name: str) -> None:
        """All of a table's constraints: one aggregation, one grouping for each key, anti joins for references."""
        table, rows = self._table(name), self.frame(name)
        self._check_rows(table, rows)
        for key in table["keys"]:
            whole = rows.where(" AND ".join(f"{quoted(c)} IS NOT NULL" for c in key))
            if not whole.groupBy(*key).count().where("count > 1").isEmpty():
                raise EngineError("constraint", f"{', '.join(key)} is not unique")
        for other_name, other in self._tables.items():
            for columns, target, target_columns in other["references"]:
                if name in (other_name, target):
                    self._check_reference(other_name, self.frame(other_name), columns, target, target_columns)

    def _check_rows(self, table: dict, rows: DataFrame) -> None:
        tests = [(f"{c['name']} is null", F.col(c["name"]).isNull()) for c in table["columns"] if not c["null"]]
        for text in table["checks"]:
            tests.append((f"check ({text}) fails", F.expr(f"NOT coalesce({self._check_sql(table, text)}, true)")))
        if tests:
            found = rows.agg(*(F.max(t.cast("int")).alias(str(i)) for i, (_, t) in enumerate(tests))).first()
            for i, (message, _) in enumerate(tests):
                if found[i]:
                    raise EngineError("constraint", message)

    def _check_sql(self, table: dict, text: str) -> str:
        lowering = Lowering(lambda _: None)
        return lowering.predicate(Parser(text).expression(), self._scope(table, "")).replace("``.", "")

    def _scope(self, table: dict, alias: str) -> Scope:
        return Scope(sources=[Source(alias, {f.name: (kind_of(f.dataType), False) for f in self._schema(table)})])

    # -- statements
    def execute(self, text: str, params: Any = None) -> DataFrame | int | None:
        """Run one statement: a DataFrame for queries and RETURNING, else the number of rows changed or None."""
        p = Parser(text)
        if p.peek("select", "with"):
            return self.snapshot().sql(text, params)
        word = p.name() if p.tokens[0].kind == "name" else p.need("insert", "update", "delete")
        if word in ("begin", "commit", "rollback", "savepoint", "release"):
            return self._transaction(word, p)
        held = deepcopy(self._tables)
        try:
            out = getattr(self, f"_do_{word}", self._unknown)(p, params)
            p.take(";")
            if not p.end():
                raise EngineError("format", f"unexpected {p.tokens[p.at].text!r}")
        except BaseException:
            self._tables = held
            raise
        if not self._open:
            self._commit()
        return out

    def script(self, text: str) -> list:
        """Statements one after another; the whole text is lexed first."""
        return [self.execute(s) for s in statements(text)]

    def _unknown(self, p: Parser, params: Any) -> None:
        raise EngineError("unsupported", "no such statement")

    def _transaction(self, word: str, p: Parser) -> None:
        if word == "begin":
            if self._open:
                raise EngineError("state", "a transaction is open")
            self.refresh()
            self._open, self._savepoints = True, []
        elif word == "savepoint":
            if not self._open:
                self._transaction("begin", p)
            self._savepoints.append((p.name(), deepcopy(self._tables)))
        elif word == "release":
            p.take("savepoint")
            self._savepoints = self._savepoints[: self._savepoint(p.name())]
        elif word == "rollback" and p.take("to"):
            p.take("savepoint")
            at = self._savepoint(p.name())
            self._tables = deepcopy(self._savepoints[at][1])
            self._savepoints = self._savepoints[: at + 1]
        else:
            if not self._open:
                raise EngineError("state", "no transaction is open")
            self._open, self._savepoints = False, []
            if word == "commit":
                self._commit()
            else:
                self._tables = self._load(self._base)

    def _savepoint(self, name: str) -> int:
        for i in reversed(range(len(self._savepoints))):
            if self._savepoints[i][0] == name:
                return i
        raise EngineError("state", f"no savepoint {name}")

    # -- definitions
    def _do_create(self, p: Parser, params: Any) -> None:
        unique = bool(p.take("unique"))
        if p.take("index"):
            name = p.name()
            p.need("on")
            table = self._table(p.name())
            ordered = self._index_columns(p)
            columns = [c for c, _ in ordered]
            if any(name in t["indexes"] for t in self._tables.values()):
                raise EngineError("schema", f"there is an index {name}")
            if unknown := set(columns) - {c["name"] for c in table["columns"]}:
                raise EngineError("schema", f"no column {', '.join(sorted(unknown))}")
            table["indexes"][name] = ordered
            if unique:
                table["keys"].append(columns)
                self._check(next(n for n, t in self._tables.items() if t is table))
            return
        p.need("table")
        quiet = bool(p.take("if"))
        if quiet:
            p.need("not")
            p.need("exists")
        name = p.name()
        table: dict = {"path": None, "columns": [], "keys": [], "primary": [], "checks": [], "references": [], "indexes": {}}
        p.need("(")
        while True:
            self._definition(p, table)
            if not p.take(","):
                break
        p.need(")")
        if p.take("without"):
            p.name()
        if name in self._tables:
            if quiet:
                return
            raise EngineError("schema", f"there is a table {name}")
        self._tables[name] = table

    @staticmethod
    def _index_columns(p: Parser) -> list[list]:
        """[name, whether descending] of an index's columns."""
        p.need("(")
        out = []
        while True:
            name = p.name()
            out.append([name, p.take("asc", "desc") == "desc"])
            if not p.take(","):
                break
        p.need(")")
        return out

    def _text_until(self, p: Parser) -> str:
        """The source of a parenthesised expression."""
        p.need("(")
        first = p.at
        p.expression()
        text = " ".join(t.text for t in p.tokens[first : p.at])
        p.need(")")
        return text

    def _definition(self, p: Parser, table: dict) -> None:
        if p.take("primary"):
            p.need("key")
            table["primary"] = p.names()
            table["keys"].append(table["primary"])
        elif p.take("unique"):
            table["keys"].append(p.names())
        elif p.take("check"):
            table["checks"].append(self._text_until(p))
        elif p.take("foreign"):
            p.need("key")
            columns = p.names()
            p.need("references")
            target = p.name()
            table["references"].append([columns, target, p.names()])
        else:
            name = p.name()
            kind, numbers = p.type_name()
            column = {"name": name, "type": _spark_type(kind, numbers), "null": True, "default": None}
            table["columns"].append(column)
            while True:
                if p.take("primary"):
                    p.need("key")
                    table["primary"] = [name]
                    table["keys"].append([name])
                elif p.take("not"):
                    p.need("null")
                    column["null"] = False
                elif p.take("unique"):
                    table["keys"].append([name])
                elif p.take("default"):
                    first = p.at
                    p.unary()
                    column["default"] = " ".join(t.text for t in p.tokens[first : p.at])
                elif p.take("check"):
                    table["checks"].append(self._text_until(p))
                elif p.take("references"):
                    target = p.name()
                    table["references"].append([[name], target, p.names()])
                else:
                    break

    def _do_drop(self, p: Parser, params: Any) -> None:
        if p.take("index"):
            name = p.name()
            for t in self._tables.values():
                if name in t["indexes"]:
                    columns = [c for c, _ in t["indexes"].pop(name)]
                    if columns in t["keys"] and columns != t["primary"]:
                        t["keys"].remove(columns)
                    return
            raise EngineError("schema", f"no index {name}")
        p.need("table")
        quiet = bool(p.take("if"))
        if quiet:
            p.need("exists")
        name = p.name()
        if any(target == name and other != name for other, t in self._tables.items() for _, target, _ in t["references"]):
            raise EngineError("constraint", f"another table refers to {name}")
        if self._tables.pop(name, None) is None and not quiet:
            raise EngineError("schema", f"no table {name}")

    def _do_alter(self, p: Parser, params: Any) -> None:
        p.need("table")
        name = p.name()
        table = self._table(name)
        if p.take("add"):
            p.take("column")
            before = self.frame(name)
            self._definition(p, table)
            column = table["columns"][-1]
            value = self._default(column)
            self._write(name, before.withColumn(column["name"], F.expr(value).cast(column["type"])))
        else:
            p.need("rename")
            if p.take("to"):
                new = p.name()
                if new in self._tables:
                    raise EngineError("schema", f"there is a table {new}")
                self._tables[new] = self._tables.pop(name)
                for t in self._tables.values():
                    t["references"] = [[c, new if target == name else target, k] for c, target, k in t["references"]]
            else:
                p.take("column")
                old = p.name()
                p.need("to")
                self._rename(name, table, old, p.name())

    def _rename(self, name: str, table: dict, old: str, new: str) -> None:
        rows = self.frame(name)
        if old not in rows.columns or new in rows.columns:
            raise EngineError("schema", f"{old} can't become {new}")
        swap = lambda columns: [new if c == old else c for c in columns]
        for c in table["columns"]:
            c["name"] = new if c["name"] == old else c["name"]
        table["keys"], table["primary"] = [swap(k) for k in table["keys"]], swap(table["primary"])
        table["indexes"] = {n: [[swap([c])[0], down] for c, down in k] for n, k in table["indexes"].items()}
        table["checks"] = [" ".join(new if t.kind == "name" and t.value == old else t.text for t in Parser(text).tokens[:-1]) for text in table["checks"]]
        for other, t in self._tables.items():
            t["references"] = [[swap(c) if other == name else c, target, swap(k) if target == name else k] for c, target, k in t["references"]]
        self._write(name, rows.withColumnRenamed(old, new))

    def _default(self, column: dict) -> str:
        if column["default"] is None:
            return "NULL"
        lowering = Lowering(lambda _: None)
        return lowering.value_sql(lowering.expression(Parser(column["default"]).expression(), Scope()))

    # -- changes
    def _do_insert(self, p: Parser, params: Any, replace: bool = False) -> DataFrame | int:
        if p.take("or"):
            p.need("replace")
            replace = True
        p.need("into")
        name = p.name()
        table = self._table(name)
        columns = p.names() if p.peek("(") else [c["name"] for c in table["columns"]]
        if p.take("default"):
            p.need("values")
            columns, fresh = [], self.spark.range(1).drop("id")
        elif p.take("values"):
            fresh = self._values(p, columns, params)
        else:
            query = p.query()
            fresh = self._run(query, params)
            if len(fresh.columns) != len(columns):
                raise EngineError("schema", "the query's columns don't match")
            fresh = fresh.toDF(*columns)
        whole = [self._stored(F.col(c["name"]) if c["name"] in columns else F.expr(self._default(c)), fresh, c, c["name"] in columns) for c in table["columns"]]
        fresh = self._numbered(name, table, fresh.select(*whole))
        before = self.frame(name)
        if p.take("on"):
            p.need("conflict")
            return self._upsert(p, name, table, before, fresh, params)
        if replace:
            for key in table["keys"]:
                before = before.join(fresh.select(*key).dropna().distinct(), key, "left_anti").select(before.columns)
                fresh = fresh.withColumn("_at", F.monotonically_increasing_id()) if "_at" not in fresh.columns else fresh
                last = fresh.groupBy(*key).agg(F.max("_at").alias("_at"))
                whole_key = F.lit(True)
                for c in key:
                    whole_key = whole_key & F.col(c).isNotNull()
                fresh = fresh.where(whole_key).join(last.select("_at"), "_at", "left_semi").unionByName(fresh.where(~whole_key))
            fresh = fresh.drop("_at")
            return self._changed(p, name, before.unionByName(fresh), fresh, params)
        return self._changed(p, name, None, fresh, params)

    def _do_replace(self, p: Parser, params: Any) -> DataFrame | int:
        return self._do_insert(p, params, True)

    def _values(self, p: Parser, columns: list[str], params: Any) -> DataFrame:
        """VALUES as one SELECT with UNION ALL, in order."""
        rows = []
        while True:
            p.need("(")
            row = [p.expression()]
            while p.take(","):
                row.append(p.expression())
            p.need(")")
            if len(row) != len(columns):
                raise EngineError("schema", f"{len(columns)} values are needed")
            rows.append(row)
            if not p.take(","):
                break
        query = Query(arms=[("union all" if i else None, Select(items=[(v, f"c{j}") for j, v in enumerate(row)])) for i, row in enumerate(rows)])
        return self._run(query, params).coalesce(1).toDF(*columns)

    def _run(self, query: Query, params: Any) -> DataFrame:
        own = self.snapshot()
        return self.spark.sql(Lowering(own._tables.get, params).query(query)[0])

    def _stored(self, value: Any, rows: DataFrame, column: dict, given: bool) -> Any:
        """Only values that the column's type holds without loss may be stored."""
        name, kind = column["name"], column["type"]
        if not given:
            return value.cast(kind).alias(name)
        source = rows.schema[name].dataType
        if isinstance(source, T.NullType) or source.simpleString().upper() == kind:
            return value.cast(kind).alias(name)
        if kind == "DATE":
            fine = value.cast("string").rlike(r"^\d{4}-\d{2}-\d{2}$") if isinstance(source, T.StringType) else F.lit(isinstance(source, T.DateType))
            done = F.expr(f"try_cast({quoted(name)} AS DATE)")
        elif kind == "STRING":
            return value.cast("string").alias(name)
        elif kind == "BINARY":
            raise EngineError("type", f"{name} takes a blob")
        else:
            done = F.expr(f"try_cast({quoted(name)} AS {kind})")
            fine = done.isNotNull() & ((done.cast("double") == value.cast("double")) if kind != "ARRAY<FLOAT>" else F.lit(True))
        return F.when(value.isNull() | fine, done).otherwise(F.raise_error(F.lit(f"type: {name} can't hold the value"))).alias(name)

    def _numbered(self, name: str, table: dict, fresh: DataFrame) -> DataFrame:
        """Null values of an integer primary key become the numbers after the largest."""
        if len(table["primary"]) != 1:
            return fresh
        key = table["primary"][0]
        if next(c["type"] for c in table["columns"] if c["name"] == key) != "BIGINT" or fresh.where(F.col(key).isNull()).isEmpty():
            return fresh
        from tessera.sources.shared import staged

        # In row order a row without a key gets the number after the largest so far: after the largest given key
        # (or stored one) before it, plus as many as there are rows without a key since. Counts and maxima by
        # partition go through the driver; the rows don't.
        rows = staged(fresh.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()))
        top = max(0, self.frame(name).agg(F.max(key)).first()[0] or 0)
        in_part = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        free = F.sum(F.when(F.col(key).isNull(), 1).otherwise(0)).over(in_part)
        # With f rows without a key up to here, a given key k raises the base of later ones to k - f.
        rows = rows.withColumn("_free", free).withColumn("_lift", F.max(F.when(F.col(key).isNotNull(), F.col(key) - F.col("_free"))).over(in_part))
        starts, base, seen = [], top, 0
        for r in rows.groupBy("_part").agg(F.max("_free").alias("n"), F.max("_lift").alias("lift")).orderBy("_part").collect():
            starts.append((r["_part"], base, seen))
            base = max(base, base if r["lift"] is None else r["lift"] - seen)
            seen += r["n"]
        if base + seen >= 2**63 - 1:
            raise EngineError("constraint", "no key is left")
        at = F.broadcast(self.spark.createDataFrame(starts, "_part int, _base bigint, _seen bigint"))  # a row a partition
        number = F.greatest(F.col("_base"), F.coalesce(F.col("_lift") - F.col("_seen"), F.col("_base"))) + F.col("_seen") + F.col("_free")
        return rows.join(at, "_part").select(*(F.coalesce(F.col(c), number).alias(c) if c == key else F.col(c) for c in fresh.columns))

    def _upsert(self, p: Parser, name: str, table: dict, before: DataFrame, fresh: DataFrame, params: Any) -> DataFrame | int:
        """ON CONFLICT for VALUES: rows are folded one by one in order, over the stored rows that they meet."""
        target = p.names() if p.peek("(") else (table["primary"] or (table["keys"] or [[]])[0])
        if target not in table["keys"]:
            raise EngineError("schema", "the conflict target is no key")
        p.need("do")
        sets: list = []
        where = None
        if p.name() if p.tokens[p.at].kind == "name" else p.take("update"):
            if p.tokens[p.at - 1].value == "update":
                p.need("set")
                while True:
                    column = p.name()
                    p.need("=")
                    sets.append((column, p.expression()))
                    if not p.take(","):
                        break
                where = p.expression() if p.take("where") else None
        met = before.join(fresh.select(*target).dropna().distinct(), target, "left_semi").select(before.columns)
        rest = before.join(fresh.select(*target).dropna().distinct(), target, "left_anti").select(before.columns)
        held = {tuple(r[c] for c in target): tuple(r) for r in met.collect()}
        schema, changed, extra = before.schema, [], []
        for row in fresh.collect():
            key = tuple(row[c] for c in target)
            if None in key:
                extra.append(tuple(row))
                changed.append(tuple(row))
            elif key not in held:
                held[key] = tuple(row)
                changed.append(tuple(row))
            elif sets:
                new = self._fold(name, schema, held[key], tuple(row), sets, where, params)
                if new is not None:
                    held[key] = new
                    changed.append(new)
        after = rest.unionByName(self.spark.createDataFrame([*held.values(), *extra], schema))
        return self._changed(p, name, after, self.spark.createDataFrame(changed, schema), params)

    def _fold(self, name: str, schema: T.StructType, old: tuple, new: tuple, sets: list, where: Any, params: Any) -> tuple | None:
        own = Session(self.spark)
        own.register(name, self.spark.createDataFrame([old], schema))
        own.register("excluded", self.spark.createDataFrame([new], schema))
        given = dict(sets)
        bare = lambda tree: ("column", name, tree[2]) if isinstance(tree, tuple) and len(tree) == 3 and tree[0] == "column" and tree[1] is None else tuple(bare(x) for x in tree) if isinstance(tree, tuple) else [bare(x) for x in tree] if isinstance(tree, list) else tree
        items = [(bare(given[f.name]) if f.name in given else ("column", name, f.name), f.name) for f in schema]
        query = Query(arms=[(None, Select(items=items, sources=[("first", (name, name, None), None, None), ("cross", ("excluded", "excluded", None), None, None)], where=bare(where) if where else None))])
        found = self.spark.sql(Lowering(own._tables.get, params).query(query)[0]).collect()
        return tuple(found[0]) if found else None

    def _do_update(self, p: Parser, params: Any) -> DataFrame | int:
        name = p.name()
        table = self._table(name)
        p.need("set")
        sets = {}
        while True:
            column = p.name()
            p.need("=")
            sets[column] = p.expression()
            if not p.take(","):
                break
        where = p.expression() if p.take("where") else ("literal", 1)
        unknown = set(sets) - {c["name"] for c in table["columns"]}
        if unknown:
            raise EngineError("schema", f"no column {', '.join(sorted(unknown))}")
        before = self.frame(name)
        marked = self._marked(name, before, where, sets, params)
        after = marked.select(*(F.when(F.col("_hit"), self._stored(F.col(f"_new_{c['name']}"), marked.withColumnRenamed(f"_new_{c['name']}", f"_new_{c['name']}"), {**c, "name": f"_new_{c['name']}"}, True)).otherwise(F.col(c["name"])).alias(c["name"]) if c["name"] in sets else F.col(c["name"]) for c in table["columns"]), "_hit")
        return self._changed(p, name, after.drop("_hit"), after.where("_hit").drop("_hit"), params)

    def _marked(self, name: str, before: DataFrame, where: tuple, sets: dict, params: Any) -> DataFrame:
        """The rows with _hit, whether the condition is true, and _new_<column>, the values that SET gives."""
        own = self.snapshot()
        query = Query(arms=[(None, Select(items=[("star", None), (("case", None, [(where, ("literal", 1))], ("literal", 0)), "_hit"), *((tree, f"_new_{c}") for c, tree in sets.items())], sources=[("first", (name, name, None), None, None)]))])
        marked = self.spark.sql(Lowering(own._tables.get, params).query(query)[0])
        return marked.withColumn("_hit", F.col("_hit") == 1)

    def _do_delete(self, p: Parser, params: Any) -> DataFrame | int:
        p.need("from")
        name = p.name()
        before = self.frame(name)
        where = p.expression() if p.take("where") else ("literal", 1)
        marked = self._marked(name, before, where, {}, params)
        return self._changed(p, name, marked.where("NOT _hit").drop("_hit"), marked.where("_hit").drop("_hit"), params)

    def _changed(self, p: Parser, name: str, after: DataFrame | None, touched: DataFrame, params: Any) -> DataFrame | int:
        """Write the table's new rows (None: the touched ones are added); the count of those touched, or RETURNING's view of them."""
        items = None
        if p.take("returning"):
            items = [p.item()]
            while p.take(","):
                items.append(p.item())
        from tessera.sources.shared import staged

        touched = staged(touched)
        if after is None:
            self._append(name, touched)
        else:
            self._write(name, after)
        if items is None:
            return touched.count()
        own = Session(self.spark)
        own.register(name, touched)
        query = Query(arms=[(None, Select(items=items, sources=[("first", (name, name, None), None, None)]))])
        return self.spark.sql(Lowering(own._tables.get, params).query(query)[0])

    # -- upkeep
    def _do_vacuum(self, p: Parser, params: Any) -> None:
        """Rewrite each table compactly; older folders stay for readers that opened them (see prune)."""
        for name in self._tables:
            if self._tables[name]["path"]:
                self._write(name, self.frame(name).repartition(max(1, self._size(self._tables[name]) // COMPACT_BYTES)))

    def _size(self, table: dict) -> int:
        return sum(self._fs.getContentSummary(self._path(f)).getLength() for f in self._folders(table))

    def _do_analyze(self, p: Parser, params: Any) -> DataFrame:
        return self.stats()

    def _do_pragma(self, p: Parser, params: Any) -> DataFrame:
        if p.name() != "integrity_check":
            raise EngineError("unsupported", "only PRAGMA integrity_check")
        for name in self._tables:
            self._check(name)
        return self.spark.createDataFrame([("ok",)], "integrity_check string")

    def stats(self) -> DataFrame:
        """(table_name, n_rows) of all tables."""
        rows = [(n, self.frame(n).count()) for n in sorted(self._tables)]
        return self.spark.createDataFrame(rows, "table_name string, n_rows bigint")

    def prune(self) -> int:
        """Delete table folders that the latest manifest doesn't name, and say how many; older snapshots end."""
        named = {f for tables in (self._load(self._latest()), self._tables) for t in tables.values() for f in self._folders(t)}
        gone = 0
        tables = self._path(f"{self.root}/tables")
        for table in self._fs.listStatus(tables) if self._fs.exists(tables) else []:
            for version in self._fs.listStatus(table.getPath()):
                name = f"{self.root}/tables/{table.getPath().getName()}/{version.getPath().getName()}"
                if name not in named:
                    self._fs.delete(version.getPath(), True)
                    gone += 1
        return gone

    def backup(self, target: str) -> None:
        """Copy the committed state to another root; a Store opens there."""
        tables = deepcopy(self._load(self._base))
        for name, table in tables.items():
            if table["path"]:
                path = f"{target.rstrip('/')}/tables/{name}/{uuid.uuid4().hex}"
                self.spark.read.schema(self._schema(table)).parquet(*self._folders(table)).write.parquet(path)
                table["path"] = path
        other = Store(self.spark, target)
        other._tables = tables
        other._commit()
