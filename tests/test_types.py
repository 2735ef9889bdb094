"""Types and key extractors that a session adds."""

import pytest

from tessera.errors import EngineError
from tessera.plans.types import Extractor, UserType
from tessera.session import Session

CODE = UserType("code", "text", "{x} RLIKE '^[A-Z]{2}$'", "upper(trim({x}))", "concat('<', {x}, '>')")


@pytest.fixture
def s(spark):
    s = Session(spark)
    s.type(CODE)
    s.register("t", spark.createDataFrame([(1, "AB", "x y"), (2, "CD", "y"), (3, None, None)], "k bigint, c string, w string"), types={"c": "code"})
    return s


def rows(s, text):
    return [tuple(r) for r in s.sql(text).collect()]


def test_values_are_read_checked_and_shown(s):
    assert rows(s, "SELECT code ' ab' AS a, CAST(code 'cd' AS TEXT) AS b, CAST(NULL AS code) AS c") == [("AB", "<CD>", None)]
    with pytest.raises(Exception, match="not a code"):
        rows(s, "SELECT CAST(w AS code) AS c FROM t")
    with pytest.raises(EngineError):
        s.sql("SELECT CAST(k AS code) AS c FROM t")


def test_columns_compare_with_their_type_and_with_text(s):
    assert rows(s, "SELECT k FROM t WHERE c = 'ab'") == [(1,)]
    assert rows(s, "SELECT k FROM t WHERE c > code 'AB' OR c IN ('zz', 'ab') ORDER BY c DESC") == [(2,), (1,)]
    assert rows(s, "SELECT k FROM t WHERE c BETWEEN 'aa' AND 'bb'") == [(1,)]
    assert rows(s, "SELECT max(c) AS m, count(DISTINCT c) AS n FROM t") == [("CD", 2)]
    assert sorted(rows(s, "SELECT CASE c WHEN 'ab' THEN c ELSE NULL END AS x FROM t WHERE k < 3"), key=str) == [("AB",), (None,)]
    with pytest.raises(EngineError):
        s.sql("SELECT k FROM t WHERE c = 3")
    with pytest.raises(EngineError):
        s.sql("SELECT c + 1 AS x FROM t")


def test_types_meet_text_as_text(s):
    assert sorted(rows(s, "SELECT c AS x FROM t WHERE k = 1 UNION ALL SELECT 'ab'")) == [("<AB>",), ("ab",)]
    assert rows(s, "SELECT coalesce(NULL, c, code 'zz') AS x FROM t WHERE k = 3") == [("ZZ",)]


def test_names_and_order(spark, s):
    for taken in (CODE, UserType("date"), UserType("Mixed")):
        with pytest.raises(EngineError):
            s.type(taken)
    s.type(UserType("mark", ordered=False))
    assert rows(s, "SELECT mark 'a' = 'a' AS x") == [(1,)]
    with pytest.raises(EngineError):
        s.sql("SELECT mark 'a' < 'b' AS x")
    with pytest.raises(EngineError):
        s.register("u", spark.range(1), types={"id": "nothing"})
    with pytest.raises(EngineError):
        s.sql("SELECT nothing 'x' AS y")


def test_a_missing_key_is_false(s):
    s.extractor(Extractor("words", "split({x}, ' ')"))
    assert rows(s, "SELECT k FROM t WHERE contains(w, 'words', 'y') ORDER BY k") == [(1,), (2,)]
    assert rows(s, "SELECT k FROM t WHERE NOT contains(w, 'words', 'x') ORDER BY k") == [(2,), (3,)]
    assert rows(s, "SELECT k FROM t WHERE contains(w, 'words', NULL)") == []
    with pytest.raises(EngineError):
        s.sql("SELECT k FROM t WHERE contains(w, 'other', 'x')")
