"""Directed multigraphs over two tables: nodes (id, label) and edges (id, source, target, label, weight)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.errors import EngineError


class Graph:
    """A graph facade; edges stay a DataFrame and every step is a join with the frontier."""

    def __init__(self, nodes: DataFrame, edges: DataFrame):
        self.nodes, self.edges = nodes, edges

    def _steps(self, direction: str, label: str | None = None, max_weight: float | None = None) -> DataFrame:
        """(edge_id, from_id, to_id) of the edges that may be followed; a loop counts once."""
        e = self.edges
        if label is not None:
            e = e.where(F.col("label") == label)
        if max_weight is not None:
            e = e.where(F.col("weight") <= max_weight)
        out = e.select(F.col("id").alias("edge_id"), F.col("source").alias("from_id"), F.col("target").alias("to_id"))
        back = e.select(F.col("id").alias("edge_id"), F.col("target").alias("from_id"), F.col("source").alias("to_id"))
        if direction == "outgoing":
            return out
        if direction == "incoming":
            return back
        if direction != "both":
            raise EngineError("type", f"no direction {direction}")
        return out.union(back.where("from_id <> to_id"))

    def neighbors(self, node: int, direction: str = "outgoing", label: str | None = None, max_weight: float | None = None) -> DataFrame:
        """(edge_id, node_id), by edge id."""
        steps = self._steps(direction, label, max_weight).where(F.col("from_id") == node)
        return steps.select("edge_id", F.col("to_id").alias("node_id")).orderBy("edge_id")

    def _need(self, *ids: int) -> None:
        if self.nodes.where(F.col("id").isin(*ids)).select("id").distinct().count() < len(set(ids)):
            raise EngineError("state", "no such node")

    def reachable(self, start: int, hops: int, direction: str = "outgoing", label: str | None = None, max_weight: float | None = None, most_vertices: int | None = None, most_edges: int | None = None) -> DataFrame:
        """(node_id, depth): each node within hops, once, at its least depth.

        most_vertices and most_edges bound the nodes found and the edges followed; beyond them it is an error.
        """
        self._need(start)
        spark = self.nodes.sparkSession
        steps = self._steps(direction, label, max_weight)
        frontier = spark.range(1).select(F.lit(start).cast("bigint").alias("node_id"), F.lit(0).cast("bigint").alias("depth"))
        levels, vertices, edges = [frontier], 1, 0
        for depth in range(1, hops + 1):
            met = frontier.join(steps, F.col("node_id") == F.col("from_id"))
            if most_edges is not None:
                edges += met.count()
                if edges > most_edges:
                    raise EngineError("resource", "too many edges")
            found = met.select(F.col("to_id").alias("node_id")).distinct()
            # Levels are kept each by itself; none is written again.
            frontier = _kept(found.join(reduce(DataFrame.union, levels), "node_id", "left_anti").select("node_id", F.lit(depth).cast("bigint").alias("depth")))
            new = frontier.count()
            if not new:
                break
            levels.append(frontier)
            vertices += new
            if most_vertices is not None and vertices > most_vertices:
                raise EngineError("resource", "too many vertices")
        return reduce(DataFrame.union, levels)

    def shortest_hop_path(self, start: int, end: int, hops: int, direction: str = "outgoing", label: str | None = None, max_weight: float | None = None, most_edges: int | None = None) -> tuple[list[int], list[int]] | None:
        """Nodes and edges of a path with the fewest edges, None if there is none within hops.

        Only edges of the label and up to max_weight are followed. Among parents the one found first wins, by
        place in the frontier and then by edge id: a node's place is the edge ids of its path, compared in order.
        """
        self._need(start, end)
        if start == end:
            return [start], []
        steps = self._steps(direction, label, max_weight)
        frontier = self.nodes.sparkSession.createDataFrame([(start, [])], "node bigint, place array<bigint>")
        levels, edges = [frontier.select("node")], 0
        for _ in range(hops):
            seen = reduce(DataFrame.union, levels).withColumnRenamed("node", "to_id")
            met = frontier.join(steps, F.col("node") == F.col("from_id"))
            if most_edges is not None:
                edges += met.count()
                if edges > most_edges:
                    raise EngineError("resource", "too many edges")
            found = met.join(seen, "to_id", "left_anti").select("to_id", F.concat("place", F.array("edge_id")).alias("place"))
            frontier = _kept(found.groupBy(F.col("to_id").alias("node")).agg(F.min("place").alias("place")))
            last = frontier.where(F.col("node") == end).first()
            if last:
                return self._along(start, last["place"]), last["place"]
            if frontier.isEmpty():
                return None
            levels.append(frontier.select("node"))
        return None

    def _along(self, start: int, edges: list[int]) -> list[int]:
        """The nodes of a path, from its few edges."""
        ends = {r["id"]: (r["source"], r["target"]) for r in self.edges.where(F.col("id").isin(*edges)).collect()}
        nodes = [start]
        for e in edges:
            source, target = ends[e]
            nodes.append(target if source == nodes[-1] else source)
        return nodes

    def add_nodes(self, nodes: DataFrame) -> Graph:
        """The graph with more nodes; their ids must be new and different."""
        ids = nodes.select("id")
        if not ids.groupBy("id").count().where("count > 1 OR id IS NULL").isEmpty() or not ids.join(self.nodes, "id", "left_semi").isEmpty():
            raise EngineError("constraint", "a node's id is not unique")
        return Graph(self.nodes.unionByName(nodes), self.edges)

    def add_edges(self, edges: DataFrame) -> Graph:
        """The graph with more edges; their ids must be new and different, their ends nodes."""
        ids = edges.select("id")
        if not ids.groupBy("id").count().where("count > 1 OR id IS NULL").isEmpty() or not ids.join(self.edges, "id", "left_semi").isEmpty():
            raise EngineError("constraint", "an edge's id is not unique")
        if not Graph(self.nodes, edges).check_integrity().isEmpty():
            raise EngineError("constraint", "an edge's end is no node")
        return Graph(self.nodes, self.edges.unionByName(edges))

    def remove_edges(self, ids: DataFrame) -> Graph:
        """The graph without the edges whose id is in ids (a column id)."""
        return Graph(self.nodes, self.edges.join(ids.select("id").distinct(), "id", "left_anti").select(self.edges.columns))

    def remove_nodes(self, ids: DataFrame, cascade: bool = True) -> Graph:
        """The graph without the nodes whose id is in ids, and without their edges; without cascade, nodes with edges are an error."""
        gone = ids.select(F.col("id").alias("gone")).distinct()
        kept = self.edges.join(gone, F.col("source") == F.col("gone"), "left_anti").join(gone, F.col("target") == F.col("gone"), "left_anti")
        if not cascade and kept.count() < self.edges.count():
            raise EngineError("constraint", "a node has edges")
        return Graph(self.nodes.join(gone, F.col("id") == F.col("gone"), "left_anti"), kept)

    def check_integrity(self) -> DataFrame:
        """Edges whose source or target is no node."""
        ids = self.nodes.select(F.col("id").alias("node"))
        return self.edges.join(ids, F.col("source") == F.col("node"), "left_anti").union(self.edges.join(ids, F.col("target") == F.col("node"), "left_anti")).distinct()


def _kept(df: DataFrame) -> DataFrame:
    """The same rows with their lineage cut, in the folder that driver and executors share."""
    from tessera.sources.shared import staged

    return staged(df)
