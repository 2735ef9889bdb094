"""Sessions: remembered lowering, registered functions and aggregates, cancellation, pruning."""

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.errors import EngineError
from tessera.session import Session
from tessera.sources.store import Store


def test_registered_functions_and_aggregates(spark):
    s = Session(spark)
    s.register("t", spark.createDataFrame([(1, 2), (1, 3), (2, 4)], "k bigint, v bigint"))

    def product(v: pd.Series) -> int:
        return int(v.prod())

    s.function("product_of", F.pandas_udf(product, "bigint"), T.LongType())
    s.function("shout", lambda x: f"{x}!", T.StringType())
    assert [tuple(r) for r in s.sql("SELECT k, product_of(v) AS p FROM t GROUP BY k ORDER BY k").collect()] == [(1, 6), (2, 4)]
    assert s.sql("SELECT shout(k) AS x FROM t WHERE k = 2").first().x == "2!"


def test_lowering_is_remembered_until_tables_change(spark):
    s = Session(spark)
    s.register("t", spark.range(3))
    assert s.lower("SELECT * FROM t") is s.lower("SELECT * FROM t")
    s.register("t", spark.range(3).selectExpr("id AS other"))
    assert s.sql("SELECT * FROM t").columns == ["other"]


def test_deadline(spark):
    s = Session(spark)
    s.register("t", spark.range(40_000))
    assert len(s.collect("SELECT id FROM t WHERE id < 5", seconds=60)) == 5
    with pytest.raises(EngineError) as e:
        s.collect("SELECT count(*) FROM t AS a JOIN t AS b ON a.id * 3 % 7 < b.id % 5 AND a.id & b.id < 3", seconds=0.5)
    assert e.value.code == "cancelled"


def test_prune(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    store.script("CREATE TABLE t (i INTEGER); INSERT INTO t VALUES (1); INSERT INTO t VALUES (2); VACUUM")
    assert store.prune() == 2 and store.execute("SELECT count(*) AS n FROM t").first().n == 2


def test_functions_belong_to_their_session(spark):
    one, two = Session(spark), Session(spark)
    for s, mark in ((one, "!"), (two, "?")):
        s.register("t", spark.createDataFrame([(1,)], "k bigint"))
        s.function("shout", lambda x, mark=mark: f"{x}{mark}", T.StringType())
    assert one.sql("SELECT shout(k) AS x FROM t").first().x == "1!" and two.sql("SELECT shout(k) AS x FROM t").first().x == "1?"


def test_cursor_fetches_some_rows_at_a_time(spark):
    s = Session(spark)
    s.register("t", spark.range(7))
    c = s.cursor("SELECT id FROM t ORDER BY id")
    assert [r.id for r in c.fetch(3)] == [0, 1, 2] and [r.id for r in c.fetch(9)] == [3, 4, 5, 6] and c.fetch(1) == []
    c.close()
    with pytest.raises(EngineError):
        c.fetch(1)


def test_rowid_names_the_integer_key(spark):
    s = Session(spark)
    s.register("t", spark.createDataFrame([(5, "a"), (6, "b")], "k bigint, s string"), "k")
    s.register("plain", spark.range(2))
    assert s.sql("SELECT rowid AS r, s FROM t WHERE t.rowid > 5").first() == (6, "b")
    with pytest.raises(EngineError):
        s.sql("SELECT rowid FROM plain")


def test_a_script_is_cut_outside_literals():
    from tessera.plans.syntax import statements

    assert statements("SELECT 'a;b' AS x; SELECT \"c;d\" FROM t -- e;f\n;") == ["SELECT 'a;b' AS x", 'SELECT "c;d" FROM t']
