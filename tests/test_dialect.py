"""The dialect's own rules: values computed by hand, some against sqlite3, and errors at bind time."""

import sqlite3

import pytest

from tessera.errors import EngineError
from tessera.session import Session


@pytest.fixture(scope="module")
def s(spark):
    own = Session(spark)
    own.register("t", spark.createDataFrame([(1, 2.5, "a"), (2, None, "B"), (None, 0.0, "10")], "i bigint, r double, s string"))
    own.register("u", spark.createDataFrame([(1, [1.0, 2.0])], "i bigint, v array<float>"))
    return own


def one(s, text, params=None):
    return list(s.sql(text, params).collect()[0])


# Expressions on which this dialect and sqlite3 agree.
SAME = [
    "7/2", "-7/2", "7/0", "7%3", "-7%3", "1.0/0", "1+2*3", "1 = 1", "NULL = 1", "NULL IS NULL", "3 IN (1,2)", "NULL IN (1)", "1 IN ()", "NULL NOT IN ()",
    "2 BETWEEN 1 AND 3", "NULL BETWEEN 1 AND 0", "1 BETWEEN 2 AND NULL", "'Abc' LIKE 'aB%'", "'É' LIKE 'é'", "'a' || 1", "'a' || 1.5", "CASE WHEN NULL THEN 1 ELSE 2 END",
    "CASE 1 WHEN 1 THEN 'x' END", "coalesce(NULL, 3)", "CAST('12abc' AS INTEGER)", "CAST(-3.9 AS INTEGER)", "CAST('x' AS REAL)", "CAST(1e20 AS TEXT)", "CAST(0.1 AS TEXT)",
    "abs(-4)", "length('héé')", "substr('hello', 2, 3)", "6 & 3", "NOT NULL", "NOT 0", "1 AND NULL", "0 AND NULL", "1 OR NULL", "2 > 1.5", "hex(X'0aff')", "round(2.5)", "round(-2.5)",
]


@pytest.mark.parametrize("text", SAME)
def test_like_sqlite(s, text):
    assert one(s, f"SELECT {text} AS x")[0] == sqlite3.connect(":memory:").execute(f"SELECT {text}").fetchone()[0]


def test_set_operations_nest_from_the_left(s):
    assert one(s, "SELECT 1 AS a UNION SELECT 2 INTERSECT SELECT 2") == [2]


def test_in_subquery_as_a_value_may_be_unknown(s):
    assert one(s, "SELECT 5 IN (SELECT i FROM t) AS a, 1 IN (SELECT i FROM t) AS b, NULL IN (SELECT i FROM t WHERE i > 9) AS c") == [None, 1, 0]


def test_scalar_subquery_takes_a_first_row_or_null(s):
    assert one(s, "SELECT (SELECT i FROM t ORDER BY i DESC) AS a, (SELECT i FROM t WHERE i > 9) AS b") == [2, None]


def test_parameters(s):
    assert one(s, "SELECT ? + ?2 AS a, ?1 AS b", [1, 2]) == [3, 1]
    assert one(s, "SELECT :x || $y AS a", {"x": "p", "y": "q'"}) == ["pq'"]


def test_names_of_outputs(s):
    assert s.sql("SELECT i, i + 1, s AS z FROM t").columns == ["i", "column2", "z"]


@pytest.mark.parametrize(
    ("text", "code"),
    [
        ("SELECT x FROM t", "schema"), ("SELECT i FROM missing", "schema"), ("SELECT 1 +", "format"), ("SELECT 1 LIMIT -1", "type"), ("SELECT count(DISTINCT *) FROM t", "unsupported"),
        ("SELECT max(v) FROM u", "type"), ("SELECT i FROM u ORDER BY v", "type"), ("SELECT * FROM (SELECT i, i FROM t) AS d", "schema"), ("SELECT row_number() OVER (ORDER BY i) FROM t", "unsupported"),
        ("WITH RECURSIVE a AS (SELECT 1) SELECT * FROM a", "unsupported"), ("SELECT i FROM t, u", "schema"), ("SELECT count(*) FROM t WHERE count(*) > 1", "type"), ("SELECT ?", "state"), ("SELECT extract(month FROM DATE '2024-01-01')", "unsupported"),
    ],
)
def test_errors(s, text, code):
    with pytest.raises(EngineError) as e:
        s.sql(text)
    assert e.value.code == code


def test_overflow_is_an_error(s):
    with pytest.raises(Exception, match="OVERFLOW"):
        s.sql("SELECT 9223372036854775807 + i AS x FROM t").collect()


def test_reals_stay_finite(s):
    with pytest.raises(Exception, match="not finite"):
        s.sql("SELECT 1e308 * 10.0 * r AS x FROM t WHERE i = 1").collect()


def test_cursor_and_visitor(s):
    assert len(list(s.cursor("SELECT i FROM t"))) == 3
    assert s.each("SELECT i FROM t", lambda row: False) == 1
