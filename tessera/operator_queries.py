"""Queries of the operators that have no SQL spelling, and of extras beyond the dialect (x_*)."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import box, contains, contains_any, json_key, overlaps, timestamp_delta_us
from tessera.operators.graph import Graph
from tessera.operators.vectors import nearest
from tessera.plans.types import Extractor, UserType
from tessera.session import Session
from tessera.streaming.windows import sessions, tumbling_counts

PROBE_OF = 3  # the embedding that the vector queries search for


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _probe(spark: SparkSession, sf_dir: str) -> list[float]:
    return _read(spark, sf_dir, "embeddings").where(F.col("vec_id") == PROBE_OF).first()["embedding"]


def _graph(spark: SparkSession, sf_dir: str) -> Graph:
    nodes = _read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("id"), F.col("n_name").alias("label"))
    s = _read(spark, sf_dir, "supplier")
    edges = s.select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").cast("bigint").alias("source"), (F.col("s_suppkey") % 25).alias("target"), F.when(F.col("s_acctbal") > 5000, "rich").otherwise("poor").alias("label"), F.abs("s_acctbal").alias("weight"))
    return Graph(nodes, edges)


_EDGES = "SELECT s_suppkey AS id, CAST(s_nationkey AS BIGINT) AS source, s_suppkey % 25 AS target, CASE WHEN s_acctbal > 5000 THEN 'rich' ELSE 'poor' END AS label, abs(s_acctbal) AS weight FROM supplier"


def vec_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(_read(spark, sf_dir, "embeddings"), "embedding", _probe(spark, sf_dir), 10, "vec_id").select("vec_id")


def vec_topk_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(_read(spark, sf_dir, "embeddings"), "embedding", _probe(spark, sf_dir), 10, "vec_id", where=(F.col("vec_id") > 100) & (F.col("vec_id") <= 400)).select("vec_id")


_L2 = "list_sum(list_transform(list_zip(e.embedding, p.embedding), lambda x: (CAST(x[1] AS DOUBLE) - CAST(x[2] AS DOUBLE)) * (CAST(x[1] AS DOUBLE) - CAST(x[2] AS DOUBLE))))"
_TOP = f"SELECT e.vec_id AS vec_id FROM embeddings AS e, (SELECT embedding FROM embeddings WHERE vec_id = {PROBE_OF}) AS p WHERE %s ORDER BY {_L2}, e.vec_id LIMIT 10"


def spatial_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _read(spark, sf_dir, "part")
    x, y = F.col("p_size").cast("double"), (F.col("p_partkey") % 50).cast("double")
    mine = p.select("p_partkey", box(x, y, x + 3, y + 2).alias("b"))
    return mine.where(overlaps(F.col("b"), box(*(F.lit(float(v)) for v in (10, 10, 12, 20))))).select("p_partkey")


def json_int(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "events").select("event_id", json_key(F.col("props"), "/k", "int").alias("k"))


def json_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = F.concat(F.lit('{"u": {"name": "u'), F.col("user_id").cast("string"), F.lit('"}}'))
    return _read(spark, sf_dir, "events").select("event_id", json_key(made, "/u/name", "text").alias("name"))


def json_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "events").where(~contains(json_key(F.col("props"), "/k", "int"), 7)).select("event_id")


def extractor_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "documents").where(contains_any(F.split("text", " "), "the")).select("doc_id")


def fn_ts_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "orders").select("o_orderkey", timestamp_delta_us(F.col("o_orderdate"), F.lit("1992-01-01").cast("timestamp_ntz")).alias("us"))


def graph_edge_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graph(spark, sf_dir).edges


def graph_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graph(spark, sf_dir).neighbors(4, "both", label="rich")


def graph_reachable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graph(spark, sf_dir).reachable(4, 3)


def graph_shortest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _graph(spark, sf_dir).shortest_hop_path(4, 17, 6)
    return spark.createDataFrame([(len(found[1]) if found else -1,)], "hops bigint")


def udf_scalar(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.queries import session

    own = session(spark, sf_dir)
    own.function("twice", _twice(), _long())
    return own.sql("SELECT o_orderkey, twice(o_custkey) AS v FROM orders")


def _long():
    from pyspark.sql.types import LongType

    return LongType()


def _twice():
    def twice(x: pd.Series) -> pd.Series:
        return x * 2

    return F.pandas_udf(twice, "bigint")


def udaf_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.queries import session

    def product(v: pd.Series) -> int:
        return int(v.prod())

    own = session(spark, sf_dir)
    own.function("product_of", F.pandas_udf(product, "bigint"), _long())
    return own.sql("SELECT n_regionkey AS r, product_of(n_nationkey + 1) AS p FROM nation GROUP BY n_regionkey")


def user_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A type over integers that is read from and shown as text."""
    own = Session(spark)
    own.register("part", _read(spark, sf_dir, "part"))
    own.type(UserType("brand", "int", "{x} BETWEEN 0 AND 99", "try_cast(regexp_extract({x}, '^Brand#([0-9]+)$', 1) AS BIGINT)", "concat('Brand#', {x})"))
    return own.sql("SELECT CAST(b AS TEXT) AS brand, count(*) AS n, min(b) AS least FROM (SELECT CAST(p_brand AS brand) AS b FROM part) AS p WHERE b >= brand 'Brand#23' AND b <> 'Brand#31' GROUP BY b")


def extractor_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without a word, by a registered key extractor."""
    own = Session(spark)
    own.register("documents", _read(spark, sf_dir, "documents"))
    own.extractor(Extractor("words", "split({x}, ' ')"))
    return own.sql("SELECT doc_id FROM documents WHERE NOT contains(text, 'words', 'the')")


def graph_edge_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges after nodes and edges came and went."""
    g = _graph(spark, sf_dir)
    g = g.add_nodes(spark.createDataFrame([(100, "new")], "id bigint, label string")).add_edges(spark.createDataFrame([(-1, 100, 4, "rich", 1.0)], "id bigint, source bigint, target bigint, label string, weight double"))
    return g.remove_nodes(spark.range(3, 5)).remove_edges(spark.range(10, 20)).edges


def x_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tumbling_counts(_read(spark, sf_dir, "events")).select("event_type", "n", F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"))


def x_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions(_read(spark, sf_dir, "events")).groupBy("n").agg(F.count("*").alias("sessions"))


def x_topk_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return _read(spark, sf_dir, "orders").withColumn("r", F.row_number().over(w)).where("r <= 2").select("o_custkey", "o_orderkey")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = (vec_topk, vec_topk_filtered, spatial_overlaps, json_int, json_text, json_contains, extractor_multi, fn_ts_delta, graph_edge_fields, graph_neighbors, graph_reachable, graph_shortest, graph_edge_changes, user_type, extractor_sql, udf_scalar, udaf_product, x_tumbling, x_sessions, x_topk_per_group)
    return {f.__name__: f for f in named}


def oracle_sql() -> dict[str, str]:
    walk = "WITH RECURSIVE e AS (" + _EDGES + "), w(node_id, depth) AS (SELECT CAST(4 AS BIGINT), CAST(0 AS BIGINT) UNION SELECT e.target, w.depth + 1 FROM w JOIN e ON e.source = w.node_id WHERE w.depth < {n}) "
    return {
        "vec_topk": _TOP % "true",
        "vec_topk_filtered": _TOP % "e.vec_id > 100 AND e.vec_id <= 400",
        "spatial_overlaps": "SELECT p_partkey FROM part WHERE p_size <= 12 AND p_size + 3 >= 10 AND p_partkey % 50 <= 20 AND p_partkey % 50 + 2 >= 10",
        "json_int": "SELECT event_id, CASE WHEN json_type(props, '/k') IN ('UBIGINT', 'BIGINT') THEN CAST(json_extract_string(props, '/k') AS BIGINT) END AS k FROM events",
        "json_text": "SELECT event_id, 'u' || CAST(user_id AS VARCHAR) AS name FROM events",
        "json_contains": "SELECT event_id FROM events WHERE NOT coalesce(json_extract_string(props, '/k') = '7', false)",
        "extractor_multi": "SELECT doc_id FROM documents WHERE list_contains(string_split(text, ' '), 'the')",
        "fn_ts_delta": "SELECT o_orderkey, epoch_us(o_orderdate) - epoch_us(TIMESTAMP '1992-01-01') AS us FROM orders",
        "graph_edge_fields": _EDGES,
        "graph_neighbors": "SELECT id AS edge_id, target AS node_id FROM (" + _EDGES + ") WHERE label = 'rich' AND source = 4 UNION ALL SELECT id, source FROM (" + _EDGES + ") WHERE label = 'rich' AND target = 4 AND source <> 4",
        "graph_reachable": walk.format(n=3) + "SELECT node_id, min(depth) AS depth FROM w GROUP BY node_id",
        "graph_shortest": walk.format(n=6) + "SELECT coalesce(min(depth), -1) AS hops FROM w WHERE node_id = 17",
        "user_type": "SELECT p_brand AS brand, count(*) AS n, CAST(substr(p_brand, 7) AS BIGINT) AS least FROM part WHERE CAST(substr(p_brand, 7) AS BIGINT) >= 23 AND p_brand <> 'Brand#31' GROUP BY 1, 3",
        "extractor_sql": "SELECT doc_id FROM documents WHERE NOT coalesce(list_contains(string_split(text, ' '), 'the'), false)",
        "udf_scalar": "SELECT o_orderkey, o_custkey * 2 AS v FROM orders",
        "udaf_product": "SELECT CAST(n_regionkey AS BIGINT) AS r, CAST(product(n_nationkey + 1) AS BIGINT) AS p FROM nation GROUP BY 1",
        "graph_edge_changes": "SELECT * FROM (" + _EDGES + ") WHERE source NOT IN (3, 4) AND target NOT IN (3, 4) AND (id < 10 OR id >= 20)",
        "x_tumbling": "SELECT event_type, count(*) AS n, strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M') AS start FROM events GROUP BY 1, 3",
        "x_sessions": "WITH f AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM f) SELECT n, count(*) AS sessions FROM (SELECT user_id, k, count(*) AS n FROM s GROUP BY 1, 2) GROUP BY 1",
        "x_topk_per_group": "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 2",
    }
