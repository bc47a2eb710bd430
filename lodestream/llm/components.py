"""Connected components of an edge table, by alternating large-star and small-star."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.llm.scratch import save, spent
from lodestream.llm.words import lean


class Forest:
    """Union-find over hashable nodes; the root of a tree is its least node."""

    def __init__(self) -> None:
        self.up: dict = {}

    def find(self, x):
        up = self.up
        root = x
        while (y := up.get(root, root)) != root:
            root = y
        while x != root:
            up[x], x = root, up.get(x, x)
        return root

    def join(self, a, b) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        if b < a:
            a, b = b, a
        self.up[b] = a
        return True

    def edges(self) -> tuple[list, list]:
        nodes = list(self.up)
        return nodes, [self.find(x) for x in nodes]


#: Edges after which a task hands on what it has joined so far.
LOCAL_EDGES = 500_000


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of one partition as stars, at most one per node."""
    forest, schema, n = Forest(), None, 0
    for batch in batches:
        schema = batch.schema
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            forest.join(a, b)
        n += batch.num_rows
        if n >= LOCAL_EDGES:
            yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(forest.edges(), schema, strict=True)], schema=schema)
            forest, n = Forest(), 0
    if schema is not None:
        yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(forest.edges(), schema, strict=True)], schema=schema)


#: A node with more than this share of all edges' ends is joined apart from the others: there are at most 1000.
HUB_SHARE = 1e-3


def _stars(edges: DataFrame, ends: int, large: bool) -> DataFrame:
    """edges (a, b), both nodes of each edge in either order; ends: twice their number.

    Minima are combined before the shuffle. The edges of hubs meet their minimum
    by a broadcast of at most 1 / HUB_SHARE rows, the others by a shuffle in which
    no node has many.
    """
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    if not large:
        both = both.where("b < a")
    least = both.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")).select(F.col("a").alias("at"), F.least("a", "m").alias("m"), "n")
    least = save(least, "components-least")
    bound = max(1000, int(ends * HUB_SHARE))
    hubs = least.where(F.col("n") > bound).select(F.col("at").alias("hub"), F.col("m").alias("hub_m"))
    told = both.join(F.broadcast(hubs), F.col("a") == F.col("hub"), "left")
    met = told.where("hub is not null").select("a", "b", F.col("hub_m").alias("m"))
    met = met.unionByName(told.where("hub is null").select("a", "b").join(least.where(F.col("n") <= bound), F.col("a") == F.col("at")).select("a", "b", "m"))
    if large:  # larger neighbours move to the least neighbour
        moved = met.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:  # smaller neighbours and the node itself move to the least
        moved = met.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("at").alias("a"), F.col("m").alias("b")))
    out = save(moved.where("a <> b").distinct(), "components")
    spent(least)
    return out


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of an edge; root is the least node of its component.

    Nodes may be of any orderable type. Edges with a null and loops are ignored;
    repeated edges count once. Without edges the result is empty. Superseded
    rounds are deleted. A component of n nodes takes O(log^2 n) rounds. Before
    them edges are contracted task by task, in fewer and fewer tasks: a node of a
    large group has an edge from each task that met it, and else all of those
    would be joined in every round.
    """
    edges = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null and a <> b")
    schema = edges.schema
    edges = save(edges.mapInArrow(lean(_contract), schema), "components")

    def state(e: DataFrame):
        return e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()

    before, tasks = state(edges), 0
    while before[0] and tasks != 1:
        tasks = -(-before[0] // LOCAL_EDGES)
        less = save(edges.coalesce(tasks).mapInArrow(lean(_contract), schema), "components")
        spent(edges)
        edges, last, before = less, before, state(less)
        if 2 * before[0] > last[0]:
            break
    while before[0]:
        half = _stars(edges, 2 * before[0], True)
        spent(edges)
        edges = _stars(half, 2 * half.count(), False)
        spent(half)
        now = state(edges)
        if now == before:
            break
        before = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
