"""The structured API gives what the text gives; the llm folder may be missing."""

import subprocess
import sys
from pathlib import Path

from tessera.operators.graph import Graph
from tessera.plans.builder import Table, call, column
from tessera.session import Session

ROOT = Path(__file__).resolve().parents[1]


def test_builder_like_text(spark):
    s = Session(spark)
    s.register("o", spark.createDataFrame([(1, 10.0, "a"), (2, 20.0, "b"), (2, 30.0, "b")], "k bigint, v double, s string"))
    s.register("c", spark.createDataFrame([(1, "x"), (2, "y")], "k bigint, name string"))
    built = Table.of("o").join("c", using=["k"]).where(column("v") > 5).group(column("name")).having(call("count") >= 1).select(column("name"), total=call("sum", column("v"))).order(column("name")).limit(5)
    text = "SELECT name, sum(v) AS total FROM o JOIN c USING (k) WHERE v > 5 GROUP BY name HAVING count(*) >= 1 ORDER BY name LIMIT 5"
    assert built.run(s).collect() == s.sql(text).collect()
    union = Table.of("o").select(column("k")).combine("except", Table.of("c").where(column("name") == "x").select(column("k")))
    assert [r.k for r in union.run(s).collect()] == [2]


def test_graph(spark):
    nodes = spark.createDataFrame([(i, "n") for i in range(1, 7)], "id bigint, label string")
    edges = spark.createDataFrame([(10, 1, 2, "a", 1.0), (11, 1, 3, "a", 2.0), (12, 2, 4, "b", 1.0), (13, 3, 4, "a", 1.0), (14, 4, 5, "a", 1.0), (15, 5, 5, "a", 1.0), (16, 5, 9, "a", 1.0)], "id bigint, source bigint, target bigint, label string, weight double")
    g = Graph(nodes, edges)
    assert g.shortest_hop_path(1, 5, 9) == ([1, 2, 4, 5], [10, 12, 14])
    assert g.shortest_hop_path(1, 6, 9) is None and g.shortest_hop_path(1, 5, 2) is None
    assert {(r.node_id, r.depth) for r in g.reachable(1, 2).collect()} == {(1, 0), (2, 1), (3, 1), (4, 2)}
    assert [r.edge_id for r in g.neighbors(5, "both").collect()] == [14, 15, 16]
    assert [r.id for r in g.check_integrity().collect()] == [16]


def test_entry_without_the_training_data_operators(tmp_path):
    for name in ("tessera", "__spark_entry__.py"):
        (tmp_path / name).symlink_to(ROOT / name) if name.endswith(".py") else None
    (tmp_path / "tessera").mkdir()
    for p in (ROOT / "tessera").iterdir():
        if p.name not in ("llm", "__pycache__"):
            (tmp_path / "tessera" / p.name).symlink_to(p)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'tpch_q1' in q and 'pipeline' not in q; e.oracle_sql()"
    done = subprocess.run([sys.executable, "-c", f"import sys; sys.path.insert(0, {str(tmp_path)!r}); sys.dont_write_bytecode = True; {code}"], cwd=tmp_path, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr


def test_graph_changes_filters_and_budgets(spark):
    import pytest

    from tessera.errors import EngineError

    nodes = spark.createDataFrame([(i, "n") for i in range(1, 6)], "id bigint, label string")
    kind = "id bigint, source bigint, target bigint, label string, weight double"
    g = Graph(nodes, spark.createDataFrame([(10, 1, 2, "a", 1.0), (11, 2, 5, "b", 1.0), (12, 1, 3, "a", 9.0), (13, 3, 4, "a", 1.0), (14, 4, 5, "a", 1.0)], kind))
    assert g.shortest_hop_path(1, 5, 9) == ([1, 2, 5], [10, 11])
    assert g.shortest_hop_path(1, 5, 9, label="a") == ([1, 3, 4, 5], [12, 13, 14])
    assert g.shortest_hop_path(1, 5, 9, label="a", max_weight=5.0) is None
    for budget in (lambda: g.reachable(1, 5, most_edges=3), lambda: g.shortest_hop_path(1, 5, 9, label="a", most_edges=2)):
        with pytest.raises(EngineError):
            budget()
    more = g.add_nodes(spark.createDataFrame([(6, "m")], "id bigint, label string")).add_edges(spark.createDataFrame([(15, 5, 6, "c", 1.0)], kind))
    assert more.shortest_hop_path(1, 6, 9)[0] == [1, 2, 5, 6]
    for wrong in ([(15, 1, 9, "c", 1.0)], [(10, 1, 2, "c", 1.0)]):
        with pytest.raises(EngineError):
            g.add_edges(spark.createDataFrame(wrong, kind))
    with pytest.raises(EngineError):
        g.add_nodes(spark.createDataFrame([(1, "m")], "id bigint, label string"))
    with pytest.raises(EngineError):
        g.remove_nodes(spark.range(2, 3), cascade=False)
    less = g.remove_nodes(spark.range(2, 3))
    assert sorted(r.id for r in less.edges.collect()) == [12, 13, 14] and less.check_integrity().isEmpty()
    assert sorted(r.id for r in g.remove_edges(spark.range(10, 12)).edges.collect()) == [12, 13, 14]
