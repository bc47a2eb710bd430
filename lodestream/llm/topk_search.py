"""Exact top-k by inner product: a ball tree per shard, searched by branch and bound.

Vectors are dealt to shards of bounded size, queries to blocks. In the first
round each query searches one shard; its k-th best score there is what the
second round starts from in all other shards, so that whole balls fall away. A
ball with centre c and radius r holds no score above q.c + |q| r. Vectors whose
lengths and directions hardly differ leave nothing to prune; the search then
reads every leaf, and stays exact.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestream.llm.scratch import save

SHARD_ROWS = 8192
BLOCK_QUERIES = 4096
LEAF = 64
_OUT = pa.schema([("query_id", pa.int64()), ("query", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


class BallTree:
    def __init__(self, vectors: np.ndarray) -> None:
        self.order = np.arange(len(vectors))
        self.nodes: list[tuple[int, int, int, int]] = []  # from, to, children
        self.centres: list[np.ndarray] = []
        self.radii: list[float] = []
        self._vectors = vectors
        self._build(0, len(vectors))
        self.centres, self.radii = np.array(self.centres), np.array(self.radii)

    def _build(self, lo: int, hi: int) -> int:
        part = self._vectors[self.order[lo:hi]]
        centre = part.mean(axis=0)
        far = np.sqrt(((part - centre) ** 2).sum(axis=1))
        me = len(self.nodes)
        self.nodes.append((lo, hi, -1, -1))
        self.centres.append(centre)
        self.radii.append(float(far.max()))
        if hi - lo > LEAF:
            pole = part[far.argmax()]
            other = part[((part - pole) ** 2).sum(axis=1).argmax()]
            mid = (hi - lo) // 2
            # halves along the line between two far points: always balanced, equal vectors too
            self.order[lo:hi] = self.order[lo:hi][np.argpartition(part @ (other - pole), mid)]
            left = self._build(lo, lo + mid)
            right = self._build(lo + mid, hi)
            self.nodes[me] = (lo, hi, left, right)
        return me

    def search(self, q: np.ndarray, k: int, floor: int | None, scores, ids: np.ndarray, rows: np.ndarray, own: int) -> list[tuple[int, int]]:
        """The k best (score, id) of score floor or more, without the row `own`; smaller ids first among equals."""
        norm = float(np.linalg.norm(q))
        bounds = self.centres @ q + norm * self.radii
        bounds += 1e-9 * np.abs(bounds) + 1e-6 * (1 + norm)  # rounding must not hide a candidate
        heap, best = [(-bounds[0], 0)], []
        while heap:
            bound, node = heapq.heappop(heap)
            if floor is not None and -bound < floor:
                break
            lo, hi, left, right = self.nodes[node]
            if left < 0:
                at = self.order[lo:hi]
                got = scores(at, q)
                best += [(-int(s), int(i)) for s, i, r in zip(got, ids[at], rows[at], strict=True) if r != own and (floor is None or s >= floor)]
                if len(best) >= k:
                    best = sorted(best)[:k]
                    floor = -best[-1][0]
            else:
                heapq.heappush(heap, (-bounds[left], left))
                heapq.heappush(heap, (-bounds[right], right))
        return [(-s, i) for s, i in sorted(best)[:k]]


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    flat = column.combine_chunks()
    flat = flat.values if isinstance(flat, pa.ListArray) else pa.concat_arrays([c.values for c in flat.chunks])
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _search(k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _OUT.empty_table()
        dim = left.column("dim")[0].as_py()
        whole, asked = (_matrix(t.column("v"), dim) for t in (left, right))
        ids, rows = left.column("vec_id").to_numpy(), left.column("row").to_numpy()
        most = float(np.abs(whole).max(initial=0)) * float(np.abs(asked).max(initial=0)) * dim
        if most < 2**53:  # sums of doubles are exact
            scores = lambda at, q: (whole[at] @ q).astype(np.int64)
        else:
            scores = lambda at, q: np.array([sum(int(a) * int(b) for a, b in zip(x, q, strict=True)) for x in whole[at].tolist()], object)
        # Bounds are taken on a scale on which squares stay finite.
        scale = max(1.0, float(np.abs(whole).max(initial=0)), float(np.abs(asked).max(initial=0)))
        scale = scale if scale > 1e100 else 1.0
        tree, out = BallTree(whole / scale), []
        for q, own, row, floor in zip(asked, right.column("vec_id").to_pylist(), right.column("row").to_pylist(), right.column("floor").to_pylist(), strict=True):
            for s, i in tree.search(q, k, floor, scores, ids, rows, row):
                if not -(1 << 63) <= s < 1 << 63:
                    raise OverflowError(f"the score of {own} and {i} is beyond a long: {s}")
                out.append((own, row, i, s))
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else [[]] * 4)], schema=_OUT)

    return run


def as_integers(vector: Column, scale: int = 1024) -> Column:
    """floor(scale * x) of every component, as doubles, which hold it exactly; null if the vector is null or has a null or non-finite one.

    A component whose product is beyond a double counts as not finite.
    """
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double") * scale) < float("inf")))
    # Doubles from 2^52 on are integers; the rest fit a long on the way.
    whole = lambda y: F.when(F.abs(y) < float(1 << 52), F.floor(y).cast("double")).otherwise(y)
    return F.when(sound & (F.size(vector) > 0), F.transform(vector, lambda x: whole(x.cast("double") * scale)))


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, key: str = "vec_id", vector: str = "embedding", shard_rows: int = SHARD_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest scores, ties to the smaller id.

    Vectors are taken as integers (as_integers); scores are their inner products.
    Rows with a null key, a null or empty vector or one with a null or non-finite
    component take no part. Only vectors of equal length are compared. A row is
    never its own candidate; other rows with its key are, and repeated rows are
    queries and candidates each. Scores are exact, whatever the size of the
    components; one that is returned and beyond a long raises OverflowError.
    Queries with fewer candidates have fewer rows; other columns are ignored;
    without rows the result is empty.
    """
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), as_integers(F.col(vector)).alias("v"), is_query.alias("asks"))
    rows = rows.where("vec_id is not null and v is not null").withColumn("dim", F.size("v")).withColumn("row", F.monotonically_increasing_id())
    rows = save(rows, "vectors")
    n, asking = rows.agg(F.count(F.lit(1)), F.count(F.when(F.col("asks"), 1))).first()
    shards, blocks = max(1, math.ceil(n / shard_rows)), max(1, math.ceil(asking / block_queries))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int"))
    queries = rows.where("asks").select("vec_id", "v", "dim", "row", "shard")
    queries = save(queries, "queries")  # columns of its own, for the cogroup
    out = "query_id long, query long, vec_id long, score long"

    first = rows.drop("asks").groupBy("dim", "shard").cogroup(queries.withColumn("floor", F.lit(None).cast("long")).groupBy("dim", "shard")).applyInArrow(_search(k), out)
    first = save(first, "topk-first")
    floors = first.groupBy("query").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("floor")).where(F.col("n") >= k).select("query", "floor")
    asked = queries.join(floors, F.col("row") == F.col("query"), "left").drop("query")
    # Every block of queries meets every shard, but for the one that a query has seen.
    asked = asked.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int")).withColumn("at", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).where("at <> shard")
    asked = asked.select("vec_id", "v", "dim", "row", "floor", "block", F.col("at").alias("shard"))
    spread = rows.drop("asks").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    keys = ("dim", "shard", "block")
    second = spread.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(_search(k), out)
    place = Window.partitionBy("query").orderBy(F.col("score").desc(), "vec_id")
    ranked = first.unionByName(second).withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
