"""Connected components of an edge table by alternating stars; nothing is collected."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Roots(dict):
    """Union-find over any ordered keys: the root of a key is the least that it is joined with."""

    def root(self, x):
        while self.setdefault(x, x) != x:
            self[x] = self[self[x]]
            x = self[x]
        return x

    def merge(self, x, y) -> bool:
        """Whether x and y were apart."""
        a, b = self.root(x), self.root(y)
        self[max(a, b)] = min(a, b)
        return a != b


#: Edges that a task brings together at once, about.
EDGES = 1 << 20


def contracted(edges: DataFrame, tasks: int) -> DataFrame:
    """The edges (a, b) dealt to so many tasks, those of each as stars around the least node that they connect there: as well connected, and never more of them."""

    def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roots, schema = Roots(), None
        for b in batches:
            schema = b.schema
            for x, y in zip(b.column("a").to_pylist(), b.column("b").to_pylist(), strict=True):
                roots.merge(x, y)
        if schema is not None:
            found = [(x, r) for x in roots if (r := roots.root(x)) != x]
            columns = zip(*found, strict=True) if found else ([], [])
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    rows = edges.where("a <> b").select("a", "b").coalesce(tasks)
    return rows.mapInArrow(contract, rows.schema)


def components(edges: DataFrame, store) -> DataFrame:
    """(node, component) for each node of the stored edges (a, b): component is the least node that it is connected with.

    Each task brings about EDGES edges together. While there is more than one task, large stars and small stars follow in turn, each a
    minimum per node and a join back, until all edges are stars around least nodes.
    """

    def star(e: DataFrame, small: bool) -> DataFrame:
        both = e.union(e.select("b", "a")) if not small else e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        joined = both.join(least, "a")
        if not small:
            return joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        return joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).distinct()

    def ended(e: DataFrame) -> bool:
        """Each node has one edge, to a node that has none itself."""
        nodes = e.groupBy("a").agg(F.count("*").alias("n"))
        return nodes.where("n > 1").isEmpty() and e.join(nodes.select(F.col("a").alias("b")), "b", "left_semi").isEmpty()

    tasks = -(-edges.count() // EDGES) or 1
    now = store(contracted(edges, tasks), "edges")
    while tasks > 1 and not ended(now):
        tasks = -(-now.count() // EDGES) or 1
        now = store(contracted(store(star(star(now, False), True), "stars"), tasks), "edges")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b").distinct())
