"""Queries of the relational operators in the dialect, each with SQL for an independent engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import Session

# The supplied tables.
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
# The integer primary keys of these, which rowid also names.
ROWIDS = {"customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey", "documents": "doc_id", "embeddings": "vec_id"}
_sessions: dict[tuple[str, str], Session] = {}


def session(spark: SparkSession, sf_dir: str) -> Session:
    """A session with the tables of a data folder; the same one for the same folder."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _sessions:
        found = Session(spark)
        for name in TABLES:
            found.register(name, spark.read.parquet(f"{sf_dir}/{name}.parquet"), ROWIDS.get(name), ordered=True)
        _sessions[key] = found
    return _sessions[key]


# name: (the dialect's text, the independent engine's SQL or None where it is the same text)
Q: dict[str, tuple[str, str | None]] = {}


#: A vector for the vector queries, and its squared distance in the independent engine's words.
PROBE = str([round((7 * i % 11 - 5) / 40, 3) for i in range(64)])
PROBE_L2 = f"list_sum(list_transform(list_zip(embedding, CAST({PROBE} AS FLOAT[])), lambda x: (CAST(x[1] AS DOUBLE) - CAST(x[2] AS DOUBLE)) * (CAST(x[1] AS DOUBLE) - CAST(x[2] AS DOUBLE))))"


def q(name: str, text: str, oracle: str | None = None) -> None:
    Q[name] = (text, oracle)


# Scans and relations
q("scan_all", "SELECT * FROM nation", "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey FROM nation")
q("scan_singleton", "SELECT 1 + 1 AS two, 'x' AS t", "SELECT CAST(2 AS BIGINT) AS two, 'x' AS t")
q("scan_pk_point", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey = 77")
q("scan_pk_range", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey BETWEEN 100 AND 200")
q("scan_composite_range", "SELECT l_orderkey, l_partkey, l_quantity FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 20 AND l_quantity < 22")
q("scan_rowid", "SELECT rowid AS id, o_totalprice FROM orders WHERE rowid BETWEEN 50 AND 90 OR orders.rowid = 7", "SELECT o_orderkey AS id, o_totalprice FROM orders WHERE o_orderkey BETWEEN 50 AND 90 OR o_orderkey = 7")
q("scan_ordered_limit", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
q("cte_shared", "WITH c AS (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY c_nationkey) SELECT a.k AS k, a.n AS n FROM c AS a JOIN c AS b ON a.k = b.k WHERE a.n >= b.n", "SELECT CAST(c_nationkey AS BIGINT) AS k, count(*) AS n FROM customer GROUP BY c_nationkey")
q("derived_colnames", "SELECT d.flag AS flag, d.n AS n FROM (SELECT l_returnflag, count(*) FROM lineitem GROUP BY l_returnflag) AS d(flag, n)", "SELECT l_returnflag AS flag, count(*) AS n FROM lineitem GROUP BY 1")
# Projection, filters
q("project_expr", "SELECT l_orderkey, l_linenumber + 1 AS next_line, l_extendedprice * 2 AS twice FROM lineitem", "SELECT l_orderkey, CAST(l_linenumber + 1 AS BIGINT) AS next_line, l_extendedprice * 2 AS twice FROM lineitem")
q("project_star", "SELECT s.*, s_acctbal + 1 AS more FROM supplier AS s", "SELECT s_suppkey, s_name, CAST(s_nationkey AS BIGINT) AS s_nationkey, s_acctbal, s_acctbal + 1 AS more FROM supplier")
q("filter_3vl", "SELECT doc_id FROM documents WHERE NOT (lang = 'en' AND NULL)", "SELECT doc_id FROM documents WHERE lang <> 'en'")
q("filter_bool", "SELECT c_custkey FROM customer WHERE (c_acctbal > 5000 OR c_mktsegment = 'BUILDING') AND NOT c_nationkey = 3")
q("filter_compare", "SELECT p_partkey FROM part WHERE p_size <> 5 AND p_retailprice >= 950 AND p_size < 30.5")
q("filter_between", "SELECT p_partkey FROM part WHERE p_size NOT BETWEEN 10 AND 40")
q("filter_in_list", "SELECT p_partkey FROM part WHERE p_size IN (1, 2, 3, NULL) AND p_partkey NOT IN ()", "SELECT p_partkey FROM part WHERE p_size IN (1, 2, 3)")
q("filter_in_subquery", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
q("project_in_3vl", "SELECT n_nationkey, n_regionkey IN (SELECT CASE WHEN r_regionkey = 4 THEN NULL ELSE r_regionkey END FROM region WHERE r_regionkey > 1) AS found FROM nation", "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, CAST(n_regionkey IN (SELECT CASE WHEN r_regionkey = 4 THEN NULL ELSE r_regionkey END FROM region WHERE r_regionkey > 1) AS BIGINT) AS found FROM nation")
q("filter_exists", "SELECT c_custkey FROM customer AS c WHERE EXISTS (SELECT 1 FROM orders AS o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 300000)")
q("filter_not_exists", "SELECT c_custkey FROM customer AS c WHERE NOT EXISTS (SELECT * FROM orders AS o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 400000)")
q("scalar_subquery", "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer)")
q("scalar_subquery_corr", "SELECT c_custkey, (SELECT max(o_totalprice) FROM orders WHERE o_custkey = c_custkey) AS top FROM customer")
q("filter_like", "SELECT n_name FROM nation WHERE n_name LIKE 'nation_1%'", "SELECT n_name FROM nation WHERE n_name ILIKE 'nation_1%'")
q("filter_like_call", "SELECT n_name FROM nation WHERE like('nation_1%', n_name)", "SELECT n_name FROM nation WHERE n_name ILIKE 'nation_1%'")
q("filter_not_like", "SELECT p_name FROM part WHERE p_name NOT LIKE '%1%'", "SELECT p_name FROM part WHERE p_name NOT ILIKE '%1%'")
q("filter_is_null", "SELECT doc_id FROM documents WHERE text IS NULL OR lang IS NOT NULL")
q("case_searched", "SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'middle' ELSE 'large' END AS class FROM part")
q("case_simple", "SELECT n_nationkey, CASE n_regionkey WHEN 0 THEN 'zero' WHEN 1 THEN 'one' END AS region_word FROM nation", "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, CASE n_regionkey WHEN 0 THEN 'zero' WHEN 1 THEN 'one' END AS region_word FROM nation")
q("coalesce", "SELECT doc_id, coalesce(NULL, lang, 'none') AS l FROM documents", "SELECT doc_id, coalesce(lang, 'none') AS l FROM documents")
# Joins
q("join_inner", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
q("join_theta", "SELECT a.n_nationkey AS x, b.n_nationkey AS y FROM nation AS a JOIN nation AS b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey", "SELECT CAST(a.n_nationkey AS BIGINT) AS x, CAST(b.n_nationkey AS BIGINT) AS y FROM nation AS a JOIN nation AS b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
q("join_range", "SELECT s_suppkey, r_regionkey FROM supplier JOIN region ON s_acctbal BETWEEN r_regionkey * 1000 AND r_regionkey * 1000 + 500", "SELECT s_suppkey, CAST(r_regionkey AS BIGINT) AS r_regionkey FROM supplier JOIN region ON s_acctbal BETWEEN r_regionkey * 1000 AND r_regionkey * 1000 + 500")
q("join_left", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 200000")
q("join_right", "SELECT o_orderkey, c_custkey FROM orders RIGHT JOIN customer ON o_custkey = c_custkey AND o_orderstatus = 'F'")
q("join_full", "SELECT s.s_suppkey AS s, c.c_custkey AS c FROM supplier AS s FULL JOIN customer AS c ON s.s_suppkey = c.c_custkey AND c.c_acctbal > 0")
q("join_full_theta", "SELECT r_regionkey AS r, n_nationkey AS n FROM region FULL JOIN nation ON r_regionkey > n_nationkey", "SELECT CAST(r_regionkey AS BIGINT) AS r, CAST(n_nationkey AS BIGINT) AS n FROM region FULL JOIN nation ON r_regionkey > n_nationkey")
q("join_cross", "SELECT r_name, n_name FROM region, nation")
q("join_multiway", "SELECT n_name, count(*) AS n FROM lineitem, orders, customer, nation WHERE l_orderkey = o_orderkey AND o_custkey = c_custkey AND c_nationkey = n_nationkey GROUP BY n_name")
q("join_star", "SELECT r_name, p_brand, sum(l_quantity) AS qty FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name, p_brand")
q("join_using_full", "SELECT k, a.x AS x, b.y AS y FROM (SELECT s_suppkey AS k, s_name AS x FROM supplier) AS a FULL JOIN (SELECT c_custkey AS k, c_name AS y FROM customer WHERE c_custkey > 50) AS b USING (k)")
q("join_self", "SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier AS a JOIN supplier AS b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey")
q("join_prefiltered", "SELECT o_orderkey, c_name FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal < 0) AS c ON o_custkey = c.c_custkey")
q("join_semi", "SELECT s_suppkey FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 49)")
q("join_anti", "SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_discount > 0.08)")
q("join_not_in_null", "SELECT n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT CASE WHEN r_regionkey = 0 THEN NULL ELSE r_regionkey END FROM region)", "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey FROM nation WHERE false")
# Aggregates
q("agg_group", "SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderpriority, o_orderstatus")
q("agg_global", "SELECT count(*) AS n, min(o_totalprice) AS low, max(o_totalprice) AS high FROM orders")
q("agg_empty", "SELECT count(*) AS n, sum(o_orderkey) AS s, max(o_orderkey) AS m FROM orders WHERE o_orderkey < 0", "SELECT count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS s, max(o_orderkey) AS m FROM orders WHERE o_orderkey < 0")
q("agg_group_expr", "SELECT extract(year FROM o_orderdate) AS y, count(*) AS n FROM orders GROUP BY extract(year FROM o_orderdate)", "SELECT CAST(year(o_orderdate) AS BIGINT) AS y, count(*) AS n FROM orders GROUP BY 1")
q("agg_group_ordinal", "SELECT p_size / 10 AS decade, count(*) AS n FROM part GROUP BY 1", "SELECT CAST(p_size // 10 AS BIGINT) AS decade, count(*) AS n FROM part GROUP BY 1")
q("agg_having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12 AND max(o_totalprice) > 250000")
q("agg_count", "SELECT count(*) AS a, count(text) AS b, count(lang) AS c FROM documents")
q("agg_sum_int", "SELECT l_returnflag, sum(l_linenumber) AS s FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, CAST(sum(l_linenumber) AS BIGINT) AS s FROM lineitem GROUP BY 1")
q("agg_sum_text", "SELECT o_orderstatus, sum(o_orderpriority) AS s FROM orders GROUP BY o_orderstatus", "SELECT o_orderstatus, sum(CAST(substr(o_orderpriority, 1, 1) AS DOUBLE)) AS s FROM orders GROUP BY 1")
q("agg_sum_real", "SELECT l_linestatus, sum(l_quantity) AS s FROM lineitem GROUP BY l_linestatus")
q("agg_sum_decimal", "SELECT l_returnflag, sum(CAST(l_linenumber AS DECIMAL(12,2)) * DECIMAL '1.10') AS s FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, CAST(sum(CAST(l_linenumber AS DECIMAL(12,2)) * CAST(1.10 AS DECIMAL(18,3))) AS DECIMAL(38,5)) AS s FROM lineitem GROUP BY 1")
q("agg_avg", "SELECT l_returnflag, avg(l_linenumber) AS a FROM lineitem GROUP BY l_returnflag")
q("agg_avg_decimal", "SELECT avg(CAST(l_linenumber AS DECIMAL(10,2))) AS a FROM lineitem", "SELECT CAST(sum(CAST(l_linenumber AS DECIMAL(10,2))) AS DOUBLE) / count(*) AS a FROM lineitem")
q("agg_min_max", "SELECT l_returnflag, min(l_shipdate) AS a, max(l_extendedprice) AS b FROM lineitem GROUP BY l_returnflag")
q("agg_group_concat", "SELECT n_regionkey, group_concat(n_name) AS names FROM nation GROUP BY n_regionkey", "SELECT CAST(n_regionkey AS BIGINT) AS n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY 1")
q("agg_distinct_multi", "SELECT l_returnflag, count(DISTINCT l_suppkey) AS a, sum(DISTINCT l_linenumber) AS b FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, count(DISTINCT l_suppkey) AS a, CAST(sum(DISTINCT l_linenumber) AS BIGINT) AS b FROM lineitem GROUP BY 1")
q("agg_expr", "SELECT o_orderstatus, max(o_orderkey) - min(o_orderkey) + count(*) AS spread FROM orders GROUP BY o_orderstatus ORDER BY count(*)", "SELECT o_orderstatus, CAST(max(o_orderkey) - min(o_orderkey) + count(*) AS BIGINT) AS spread FROM orders GROUP BY 1")
# Sorting, limits, sets
q("sort_multi", "SELECT c_mktsegment, c_custkey FROM customer ORDER BY c_mktsegment DESC, 2")
q("sort_nulls", "SELECT CASE WHEN n_regionkey = 1 THEN NULL ELSE n_regionkey END AS k, n_nationkey FROM nation ORDER BY k, n_nationkey LIMIT 7", "SELECT CAST(CASE WHEN n_regionkey = 1 THEN NULL ELSE n_regionkey END AS BIGINT) AS k, CAST(n_nationkey AS BIGINT) AS n_nationkey FROM nation ORDER BY k NULLS FIRST, n_nationkey LIMIT 7")
q("topk", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 50", "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 50")
q("limit_zero", "SELECT o_orderkey FROM orders LIMIT 0")
q("limit_offset", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 5")
q("distinct_rows", "SELECT DISTINCT o_orderpriority, o_orderstatus FROM orders")
q("set_union_all", "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier", "SELECT CAST(c_nationkey AS BIGINT) AS k FROM customer UNION ALL SELECT CAST(s_nationkey AS BIGINT) FROM supplier")
q("set_union", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier", "SELECT CAST(c_nationkey AS BIGINT) AS k FROM customer UNION SELECT CAST(s_nationkey AS BIGINT) FROM supplier")
q("set_intersect", "SELECT p_partkey AS k FROM part INTERSECT SELECT l_partkey FROM lineitem WHERE l_quantity = 50")
q("set_except", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 400000")
q("set_ordered", "SELECT c_nationkey AS k FROM customer UNION SELECT s_suppkey FROM supplier ORDER BY k DESC LIMIT 9", "SELECT CAST(c_nationkey AS BIGINT) AS k FROM customer UNION SELECT s_suppkey FROM supplier ORDER BY k DESC LIMIT 9")
q("set_chain", "SELECT r_regionkey AS k FROM region UNION SELECT n_nationkey FROM nation INTERSECT SELECT s_suppkey FROM supplier WHERE s_suppkey > 3", "(SELECT CAST(r_regionkey AS BIGINT) AS k FROM region UNION SELECT n_nationkey FROM nation) INTERSECT SELECT s_suppkey FROM supplier WHERE s_suppkey > 3")
q("set_union_mixed", "SELECT n_nationkey AS k FROM nation UNION SELECT s_acctbal FROM supplier", "SELECT CAST(n_nationkey AS DOUBLE) AS k FROM nation UNION SELECT s_acctbal FROM supplier")
# Functions
q("fn_arith_int", "SELECT o_orderkey, o_orderkey * 3 - o_custkey + 1 AS v FROM orders")
q("fn_arith_real", "SELECT l_orderkey, l_linenumber, l_quantity * 2 - 0.5 AS v FROM lineitem", "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_quantity * 2 - CAST(0.5 AS DOUBLE) AS v FROM lineitem")
q("fn_arith_text", "SELECT o_orderkey, o_orderpriority + 1 AS v, o_orderstatus * 2 AS w FROM orders", "SELECT o_orderkey, CAST(substr(o_orderpriority, 1, 1) AS DOUBLE) + 1 AS v, CAST(0 AS DOUBLE) AS w FROM orders")
q("fn_div_int", "SELECT p_partkey, p_partkey / (p_size - 5) AS v FROM part", "SELECT p_partkey, p_partkey // nullif(p_size - 5, 0) AS v FROM part")
q("fn_mod", "SELECT p_partkey, p_partkey % (p_size - 5) AS v FROM part", "SELECT p_partkey, p_partkey % nullif(p_size - 5, 0) AS v FROM part")
q("fn_bitand", "SELECT o_orderkey, o_orderkey & 12 AS v FROM orders")
q("fn_negate", "SELECT o_orderkey, -o_orderkey AS v FROM orders")
q("fn_concat", "SELECT n_nationkey, n_name || '-' || n_regionkey AS v FROM nation", "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name || '-' || CAST(n_regionkey AS VARCHAR) AS v FROM nation")
q("fn_abs", "SELECT c_custkey, abs(c_acctbal) AS v FROM customer")
q("fn_round", "SELECT s_suppkey, round(s_acctbal / 8, 1) AS v FROM supplier", "SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN -1 ELSE 1 END * floor(abs(s_acctbal / 8) * 10 + 0.5) / 10 AS v FROM supplier")
q("fn_length", "SELECT doc_id, length(text) AS n FROM documents")
q("fn_hex", "SELECT n_name, hex(n_name) AS h, hex(X'00ff41') AS b, length(X'00ff41') AS n FROM nation", "SELECT n_name, hex(n_name) AS h, '00FF41' AS b, CAST(3 AS BIGINT) AS n FROM nation")
q("fn_substring", "SELECT n_name, substring(n_name FROM 2 FOR 3) AS a, substring(n_name, 0, 3) AS b, substring(n_name, 4) AS c FROM nation", "SELECT n_name, substring(n_name, 2, 3) AS a, substring(n_name, 1, 2) AS b, substring(n_name, 4) AS c FROM nation")
q("fn_year", "SELECT o_orderkey, extract(year FROM o_orderdate) AS y FROM orders", "SELECT o_orderkey, CAST(year(o_orderdate) AS BIGINT) AS y FROM orders")
q("fn_date_parse", "SELECT o_orderkey, CAST(extract(year FROM o_orderdate) || '-06-17' AS DATE) AS d FROM orders WHERE o_orderdate >= DATE '1995-06-17'", "SELECT o_orderkey, make_date(year(o_orderdate), 6, 17) AS d FROM orders WHERE o_orderdate >= TIMESTAMP '1995-06-17'")
q("fn_decimal_arith", "SELECT p_partkey, CAST(p_size AS DECIMAL(8,2)) * DECIMAL '1.5' AS m, CAST(p_size AS DECIMAL(8,2)) + 1 AS a, CAST(p_size AS DECIMAL(8,2)) / 4 AS q FROM part", "SELECT p_partkey, CAST(p_size * 1.5 AS DECIMAL(26,5)) AS m, CAST(p_size + 1 AS DECIMAL(22,2)) AS a, CAST(p_size AS DOUBLE) / 4 AS q FROM part")
q("cast_int", "SELECT s_suppkey, CAST(s_acctbal AS INTEGER) AS a, CAST('12abc' AS INTEGER) AS b, CAST('99999999999999999999' AS BIGINT) AS c FROM supplier", "SELECT s_suppkey, CAST(trunc(s_acctbal) AS BIGINT) AS a, CAST(12 AS BIGINT) AS b, 9223372036854775807 AS c FROM supplier")
q("cast_real", "SELECT o_orderkey, CAST(o_orderpriority AS REAL) AS a, CAST(o_orderstatus AS REAL) AS b, CAST(o_custkey AS REAL) AS c FROM orders", "SELECT o_orderkey, CAST(substr(o_orderpriority, 1, 1) AS DOUBLE) AS a, CAST(0 AS DOUBLE) AS b, CAST(o_custkey AS DOUBLE) AS c FROM orders")
q("cast_text", "SELECT c_custkey, CAST(c_acctbal AS TEXT) AS a, CAST(c_custkey AS TEXT) AS b, CAST(-0.0 AS TEXT) AS d FROM customer", "SELECT c_custkey, CAST(c_acctbal AS VARCHAR) AS a, CAST(c_custkey AS VARCHAR) AS b, '0.0' AS d FROM customer")
q("cast_date", "SELECT CAST(o_orderdate AS DATE) AS d, count(*) AS n FROM orders GROUP BY 1")
q("cast_date_text", "SELECT o_orderkey, CAST(CAST(CAST(o_orderdate AS DATE) AS TEXT) AS DATE) AS d, CAST(CAST(o_orderdate AS DATE) AS TEXT) AS t FROM orders", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, strftime(o_orderdate, '%Y-%m-%d') AS t FROM orders")
q("cast_decimal", "SELECT p_partkey, CAST(p_size AS DECIMAL(6,2)) AS a, CAST(CAST(p_size AS TEXT) AS DECIMAL(5,1)) AS b, CAST('1.005' AS DECIMAL(5,2)) AS c FROM part", "SELECT p_partkey, CAST(p_size AS DECIMAL(6,2)) AS a, CAST(p_size AS DECIMAL(5,1)) AS b, CAST(1.01 AS DECIMAL(5,2)) AS c FROM part")
q("cast_vector", f"SELECT vec_id, round(vector_squared_l2(embedding, CAST('{PROBE}' AS VECTOR)), 4) AS d FROM embeddings", f"SELECT vec_id, floor({PROBE_L2} * 10000 + 0.5) / 10000 AS d FROM embeddings")
q("vector_literal", f"SELECT vec_id FROM embeddings WHERE vector_squared_l2(embedding, VECTOR '{PROBE}') < 9.0", f"SELECT vec_id FROM embeddings WHERE {PROBE_L2} < 9.0")
q("affinity_text_num", "SELECT n_nationkey FROM nation WHERE n_nationkey = '7' OR n_nationkey < 'x' AND n_regionkey = 1", "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey FROM nation WHERE n_nationkey = 7 OR n_regionkey = 1")
q("truthiness", "SELECT n_nationkey FROM nation WHERE n_regionkey AND NOT n_nationkey - 3", "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey FROM nation WHERE n_regionkey <> 0 AND NOT (n_nationkey - 3 <> 0)")
# Queries in the shape of a decision-support benchmark, on the supplied columns
REV = "l_extendedprice * (1 - l_discount)"
q("tpch_q1", "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, CAST(round(100 * sum(l_extendedprice)) AS INTEGER) AS sum_base, avg(l_quantity) AS avg_qty, count(*) AS n FROM lineitem WHERE l_shipdate <= DATE '1998-09-02' GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag, l_linestatus", "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, CAST(floor(100 * sum(l_extendedprice) + 0.5) AS BIGINT) AS sum_base, avg(l_quantity) AS avg_qty, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2")


def shaped(name: str, text: str) -> None:
    """A query whose money sums are rounded to cents, as integers, in both engines' words."""
    q(name, text.replace("MONEY(", "CAST(round(100 * ").replace(")YENOM", ") AS INTEGER)"), text.replace("MONEY(", "CAST(floor(0.5 + 100 * ").replace(")YENOM", ") AS BIGINT)").replace("DATE '", "TIMESTAMP '").replace("extract(year FROM o_orderdate)", "CAST(year(o_orderdate) AS BIGINT)"))


shaped("tpch_q3", f"SELECT l_orderkey, MONEY(sum({REV}))YENOM AS revenue, o_orderpriority FROM customer, orders, lineitem WHERE c_mktsegment = 'BUILDING' AND c_custkey = o_custkey AND l_orderkey = o_orderkey AND o_orderdate < DATE '1995-03-15' AND l_shipdate > DATE '1995-03-15' GROUP BY l_orderkey, o_orderpriority")
shaped("tpch_q4", "SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderdate >= DATE '1996-07-01' AND o_orderdate < DATE '1997-07-01' AND EXISTS (SELECT * FROM lineitem WHERE l_orderkey = o_orderkey AND l_discount > 0.05) GROUP BY o_orderpriority")
shaped("tpch_q5", f"SELECT n_name, MONEY(sum({REV}))YENOM AS revenue FROM customer, orders, lineitem, supplier, nation, region WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_suppkey = s_suppkey AND c_nationkey = s_nationkey AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_regionkey = 2 GROUP BY n_name")
shaped("tpch_q6", "SELECT MONEY(sum(l_extendedprice * l_discount))YENOM AS revenue FROM lineitem WHERE l_shipdate >= DATE '1994-01-01' AND l_shipdate < DATE '1995-01-01' AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24")
shaped("tpch_q7", f"SELECT n1.n_name AS supp, n2.n_name AS cust, MONEY(sum({REV}))YENOM AS revenue FROM supplier, lineitem, orders, customer, nation AS n1, nation AS n2 WHERE s_suppkey = l_suppkey AND o_orderkey = l_orderkey AND c_custkey = o_custkey AND s_nationkey = n1.n_nationkey AND c_nationkey = n2.n_nationkey AND (n1.n_nationkey = 6 AND n2.n_nationkey = 7 OR n1.n_nationkey = 7 AND n2.n_nationkey = 6) GROUP BY n1.n_name, n2.n_name")
shaped("tpch_q8", f"SELECT extract(year FROM o_orderdate) AS y, MONEY(sum(CASE WHEN n_nationkey = 8 THEN {REV} ELSE 0.0 END))YENOM AS part_of, MONEY(sum({REV}))YENOM AS whole FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN part ON p_partkey = l_partkey WHERE p_size < 20 GROUP BY extract(year FROM o_orderdate)")
shaped("tpch_q10", f"SELECT c_custkey, c_name, MONEY(sum({REV}))YENOM AS revenue, n_name FROM customer, orders, lineitem, nation WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_returnflag = 'R' AND c_nationkey = n_nationkey GROUP BY c_custkey, c_name, n_name")
shaped("tpch_q13", "SELECT c_count, count(*) AS custdist FROM (SELECT c_custkey, count(o_orderkey) AS c_count FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey) AS c GROUP BY c_count")
shaped("tpch_q14", f"SELECT MONEY(sum(CASE WHEN p_brand = 'Brand#11' THEN {REV} ELSE 0.0 END))YENOM AS promo, MONEY(sum({REV}))YENOM AS whole FROM lineitem, part WHERE l_partkey = p_partkey")
shaped("tpch_q15", f"WITH revenue AS (SELECT l_suppkey AS k, MONEY(sum({REV}))YENOM AS total FROM lineitem GROUP BY l_suppkey) SELECT s_suppkey, s_name, total FROM supplier, revenue WHERE s_suppkey = k AND total = (SELECT max(total) FROM revenue)")
shaped("tpch_q17", "SELECT MONEY(sum(l_extendedprice))YENOM AS total FROM lineitem, part WHERE p_partkey = l_partkey AND p_size < 15 AND l_quantity < (SELECT 0.5 * avg(l_quantity) FROM lineitem WHERE l_partkey = p_partkey)")
shaped("tpch_q18", "SELECT o_orderkey, o_custkey, sum(l_quantity) AS qty FROM orders, lineitem WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING sum(l_quantity) > 200) AND o_orderkey = l_orderkey GROUP BY o_orderkey, o_custkey")
shaped("tpch_q19", f"SELECT MONEY(sum({REV}))YENOM AS revenue FROM lineitem, part WHERE p_partkey = l_partkey AND (p_brand = 'Brand#12' AND l_quantity BETWEEN 1 AND 11 AND p_size BETWEEN 1 AND 15) OR p_partkey = l_partkey AND (p_brand = 'Brand#23' AND l_quantity BETWEEN 10 AND 20 AND p_size BETWEEN 1 AND 30)")
shaped("tpch_q21", "SELECT s_name, count(*) AS numwait FROM supplier, lineitem AS l1, orders WHERE s_suppkey = l1.l_suppkey AND o_orderkey = l1.l_orderkey AND o_orderstatus = 'F' AND l1.l_discount > 0.04 AND EXISTS (SELECT * FROM lineitem AS l2 WHERE l2.l_orderkey = l1.l_orderkey AND l2.l_suppkey <> l1.l_suppkey) AND NOT EXISTS (SELECT * FROM lineitem AS l3 WHERE l3.l_orderkey = l1.l_orderkey AND l3.l_suppkey <> l1.l_suppkey AND l3.l_discount > 0.04) GROUP BY s_name")
shaped("tpch_q22", "SELECT c_nationkey / 5 AS code, count(*) AS n, MONEY(sum(c_acctbal))YENOM AS total FROM customer WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer WHERE c_acctbal > 0.0) AND NOT EXISTS (SELECT * FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000) GROUP BY c_nationkey / 5")
Q["tpch_q22"] = (Q["tpch_q22"][0], Q["tpch_q22"][1].replace("c_nationkey / 5", "CAST(c_nationkey // 5 AS BIGINT)"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from tessera import operator_queries

    own = {name: (lambda spark, sf_dir, text=text: session(spark, sf_dir).sql(text)) for name, (text, _) in Q.items()}
    concat = own["agg_group_concat"]
    # Its order is open: tokens are compared sorted.
    own["agg_group_concat"] = lambda spark, sf_dir: concat(spark, sf_dir).withColumn("names", F.array_join(F.array_sort(F.split("names", ",")), ","))
    return own | operator_queries.queries()


def oracle_sql() -> dict[str, str]:
    from tessera import operator_queries

    return {name: other or text for name, (text, other) in Q.items()} | operator_queries.oracle_sql()
