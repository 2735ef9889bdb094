"""Sums of reals over the rows of one keyed row add in the order of the table, as the SQL's own engine does."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tessera import queries as relational
from tessera.session import Session
from tessera.sources.shared import row_group_rows

FOLDER = "/root/testdata/sf0.1"


def test_half_cents_of_an_order_are_those_of_the_sql(spark):
    c = duckdb.connect()
    for t in ("customer", "orders", "lineitem"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    mine = {tuple(r) for r in relational.queries()["tpch_q3"](spark, FOLDER).collect()}
    assert mine == set(c.sql(relational.oracle_sql()["tpch_q3"]).fetchall())


VALUES = [1e16, 1.0, 1.0, 1.0, -1e16, 0.5]


@pytest.fixture(scope="module")
def own(spark, tmp_path_factory):
    """Lines of two orders, whose sums depend on the order of rows."""
    folder = tmp_path_factory.mktemp("rows")
    lines = [(k, v) for v in VALUES for k in (1, 2)]
    spark.createDataFrame(lines, "l bigint, v double").coalesce(1).write.parquet(f"{folder}/line")
    spark.createDataFrame([(1, "a"), (2, None)], "o bigint, s string").coalesce(1).write.parquet(f"{folder}/head")
    s = Session(spark)
    s.register("line", spark.read.parquet(f"{folder}/line"), ordered=True)
    s.register("head", spark.read.parquet(f"{folder}/head"), "o", ordered=True)
    return s


def test_every_aggregate_beside_such_a_sum(own):
    text = "SELECT l, sum(v) AS t, avg(v) AS a, count(*) AS n, count(s) AS m, min(v) AS low, max(v) AS high, sum(o) + l AS w FROM head, line WHERE o = l GROUP BY l HAVING sum(v) < 9.0 AND count(*) > 5 ORDER BY l DESC"
    assert "SORT BY" in own.lower(text)
    total = 0.0
    for v in VALUES:
        total += v
    assert [tuple(r) for r in own.sql(text).collect()] == [(k, total, total / 6, 6, n, -1e16, 1e16, 7 * k) for k, n in ((2, 0), (1, 6))]
    assert own.sql("SELECT * FROM line").columns == ["l", "v"]


def test_groups_without_an_order_of_their_own_are_summed_as_before(own):
    for text in ("SELECT s, sum(v) AS t FROM head, line WHERE o = l GROUP BY s", "SELECT sum(v) AS t FROM line", "SELECT l, sum(DISTINCT v) AS t FROM head, line WHERE o = l GROUP BY l", "SELECT l, sum(v) AS t FROM head LEFT JOIN line ON o = l GROUP BY l"):
        assert "SORT BY" not in own.lower(text), text
        own.sql(text).collect()


def test_half_cents_of_a_customer_are_those_of_the_sql(spark):
    c = duckdb.connect()
    for t in ("customer", "orders", "lineitem", "nation"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    mine = {tuple(r) for r in relational.queries()["tpch_q10"](spark, FOLDER).collect()}
    assert mine == set(c.sql(relational.oracle_sql()["tpch_q10"]).fetchall())


@pytest.mark.parametrize("rows", [3000, 1500])
def test_rows_by_way_of_another_table_add_as_a_hash_join_gives_them(spark, tmp_path, rows):
    """A vector of heads at a time (2,048, or a row group's rest), the last line of each, then the last but one."""
    near = [3, 5, 1600, 2500]
    lines = [(o, 10.0 ** (7 * i * (o + 1) % 17) / 7 * (-1) ** i) for i in range(9) for o in [*near, 11]]
    pq.write_table(pa.table({"g": list(range(8))}), tmp_path / "club")
    pq.write_table(pa.table({"o": list(range(3000)), "club": [7 if o in near else o % 5 for o in range(3000)]}), tmp_path / "head", row_group_size=rows)
    pq.write_table(pa.table({"l": [o for o, _ in lines], "v": [v for _, v in lines]}), tmp_path / "line")
    s = Session(spark)
    for name, key in (("club", "g"), ("head", "o"), ("line", None)):
        s.register(name, spark.read.parquet(f"{tmp_path}/{name}"), key, ordered=True)
    of = {o: [v for key, v in lines if key == o][::-1] for o in [*near, 11]}
    vectors = [[3, 5, 1600], [2500]] if rows == 3000 else [[3, 5], [1600, 2500]]
    total, alone = 0.0, 0.0
    for v in [of[o][k] for vector in vectors for k in range(9) for o in vector]:
        total += v
    for v in of[11]:
        alone += v
    got = s.sql("SELECT g, sum(v) AS t, count(*) AS n, max(v) AS high FROM club, head, line WHERE g = club AND l = o GROUP BY g ORDER BY g")
    assert [tuple(r) for r in got.collect()] == [(1, alone, 9, max(of[11])), (7, total, 36, max(v for o in near for v in of[o]))]
    for text in ("SELECT club, sum(v) AS t FROM head, line WHERE l = o GROUP BY club", "SELECT g, sum(v) AS t FROM club, head, line WHERE g = club AND l = club GROUP BY g"):
        assert "SORT BY" not in s.lower(text), text


def test_row_groups_have_one_size_or_none(spark, tmp_path):
    found = {}
    for name, sizes in {"one": [[90]], "even": [[40, 40, 10]], "files": [[40, 40], [25]], "uneven": [[40, 30, 10]], "longer last": [[40, 50]], "none": [[]]}.items():
        (tmp_path / name).mkdir()
        for i, groups in enumerate(sizes):
            with pq.ParquetWriter(tmp_path / name / f"{i}.parquet", pa.schema([("v", pa.int64())])) as w:
                for n in groups:
                    w.write_table(pa.table({"v": list(range(n))}), row_group_size=n)
        found[name] = row_group_rows(spark, spark.read.parquet(f"{tmp_path}/{name}").inputFiles())
    assert found == {"one": 0, "even": 40, "files": 40, "uneven": 0, "longer last": 0, "none": 0}
