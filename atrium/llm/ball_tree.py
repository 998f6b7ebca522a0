"""Exact top-k inner-product search by branch and bound over a ball tree in each shard.

Candidates are dealt into shards of bounded size and queries into blocks. A task builds the
tree of its shard and answers its block. Nodes are visited in the order of the largest inner product
that their ball allows, until that bound falls below the current k-th score. A first wave of
shards gives every query a k-th score, which the second wave starts from.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from atrium.llm import textbuf
from atrium.scratch import Scratch


@dataclass(frozen=True)
class TopKConfig:
    """``scale`` turns components into integers by ``floor(scale * x)``; the others bound a task.

    A shard holds an eighth of the vectors, ``least_shard`` at least and ``shard`` at most, so that floors are shared at any size.
    """

    k: int = 10
    scale: float = 1024.0
    shard: int = 8192
    least_shard: int = 64
    block: int = 4096
    leaf: int = 64
    first_wave: float = 0.25


class BallTree:
    """Balls over the rows of an integer matrix; rows are reordered so that a node is a slice."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, leaf: int):
        order = np.argsort(ids, kind="stable")
        rows, ids = rows[order], ids[order]
        self.starts, self.ends, self.children = [], [], []
        centres, radii, smallest = [], [], []
        place = np.arange(len(rows))
        todo = [(0, len(rows), -1, 0)]
        while todo:
            start, end, parent, side = todo.pop()
            node = len(self.starts)
            part = rows[place[start:end]]
            centre = part.mean(axis=0)
            offsets = part - centre
            distance = np.sqrt((offsets * offsets).sum(axis=1))
            self.starts.append(start)
            self.ends.append(end)
            self.children.append([-1, -1])
            centres.append(centre)
            radii.append(distance.max())
            smallest.append(ids[place[start:end]].min())
            if parent >= 0:
                self.children[parent][side] = node
            if end - start > leaf and radii[-1] > 0:
                # split along the line from the farthest row to the row farthest from that one
                far = part[distance.argmax()]
                other = part[((part - far) ** 2).sum(axis=1).argmax()]
                along = part @ (other - far)
                middle = (end - start) // 2
                split = np.argsort(along, kind="stable")
                place[start:end] = place[start:end][split]
                todo += [(start, start + middle, node, 0), (start + middle, end, node, 1)]
            elif end - start > leaf:
                place[start:end] = np.sort(place[start:end])  # equal rows: by id
        self.rows, self.ids = rows[place], ids[place]
        self.centres, self.radii, self.smallest = np.array(centres), np.array(radii), np.array(smallest)

    def search(self, query: np.ndarray, own: int, k: int, floor: tuple[float, int] | None) -> tuple[list[tuple[int, int]], int]:
        """The best rows as (score, id) that beat ``floor``, and the number of leaves that were scored.

        Ties go to the smaller id; the query's own id takes no part.
        """
        bounds = self.centres @ query + self.radii * np.sqrt(query @ query)
        bounds = bounds + 1e-9 * np.abs(bounds) + 1e-6
        heap = [(-bounds[0], 0)]
        best: list[tuple[int, int]] = []  # (score, -id), the worst on top
        scored = 0
        while heap:
            bound, node = heapq.heappop(heap)
            worst = best[0] if len(best) == k else None
            if floor is not None and (worst is None or (floor[0], -floor[1]) > worst):
                worst = (floor[0], -floor[1])
            if worst is not None and -bound < worst[0]:
                break
            left, right = self.children[node]
            if left >= 0:
                heapq.heappush(heap, (-bounds[left], left))
                heapq.heappush(heap, (-bounds[right], right))
                continue
            scored += 1
            start, end = self.starts[node], self.ends[node]
            if self.radii[node] == 0 and end - start > k + 1:
                end = start + k + 1  # equal rows by id: later ones cannot enter
            scores = self.rows[start:end] @ query
            keep = np.flatnonzero(scores >= worst[0]) if worst is not None else np.arange(end - start)
            if len(keep) > 2 * k:
                keep = keep[np.lexsort((self.ids[start + keep], -scores[keep]))[: k + 1]]
            for x in keep.tolist():
                entry = (int(scores[x]), -int(self.ids[start + x]))
                if -entry[1] == own or floor is not None and entry <= (floor[0], -floor[1]):
                    continue
                if len(best) < k:
                    heapq.heappush(best, entry)
                elif entry > best[0]:
                    heapq.heapreplace(best, entry)
        return sorted(((s, -i) for s, i in best), key=lambda x: (-x[0], x[1])), scored


def _matrix(column, width: int) -> np.ndarray:
    """Rows of integers as doubles, short ones padded with zeros; products of such integers are exact."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(lists), width))
    at = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[np.repeat(np.arange(len(lists)), sizes), at] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


_FOUND = "query_id long, vec_id long, score long"


def _answer(config: TopKConfig):
    def run(table: pa.Table) -> pa.Table:
        asks = np.array(table.column("asks").to_pylist(), bool)
        width = max(1, int(pc.max(pc.list_value_length(table.column("vector"))).as_py() or 1))
        ids = table.column("vec_id").to_numpy()
        out: list[tuple[int, int, int]] = []
        rows = table.filter(pa.array(~asks))
        if rows.num_rows and asks.any():
            tree = BallTree(_matrix(rows.column("vector"), width), ids[~asks], config.leaf)
            wanted = table.filter(pa.array(asks))
            floors, floor_ids = wanted.column("floor").to_pylist(), wanted.column("floor_id").to_pylist()
            for q, own, f, i in zip(_matrix(wanted.column("vector"), width), ids[asks].tolist(), floors, floor_ids):
                found, _ = tree.search(q, own, config.k, None if f is None else (f, i))
                out += [(own, i, s) for s, i in found]
        columns = list(zip(*out)) if out else [[], [], []]
        return pa.table([textbuf.int64s(np.array(c, np.int64)) for c in columns], names=["query_id", "vec_id", "score"])

    return run


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def quantised(vectors: DataFrame, scale: float) -> DataFrame:
    """``vec_id, vector``: ``floor(scale * x)`` of each component as a double; unusable rows are left out."""
    v = F.col("embedding").cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.where(v.isNotNull() & finite & F.col("vec_id").isNotNull())
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(v, lambda x: F.floor(x * F.lit(scale))).alias("vector"))


def top_k(vectors: DataFrame, is_query: Column, config: TopKConfig = TopKConfig()) -> DataFrame:
    """The ``k`` highest integer inner products of every query row with all other rows.

    Reads ``vec_id`` (integer) and ``embedding``; ``is_query`` is a condition on ``vec_id``. Returns
    ``query_id, rank (from 1), vec_id, score``; ties go to the smaller vec_id. Vectors that are
    null or hold null or non-finite components, and rows with a null vec_id, take no part.
    A row that repeats both id and vector counts once; a query's own id is never its answer; query
    rows that share an id pool their answers.
    Of vectors of different lengths the shorter is filled up with zeros. Scores are exact while they stay
    below 2 to the 53rd. An empty table, or no query row, gives an empty result.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "topk")
    rows = scratch.keep("rows", quantised(vectors, config.scale).distinct())
    n, asked = rows.agg(F.count("*"), F.count_if(is_query)).collect()[0]
    size = min(config.shard, max(config.least_shard, -(-n // 8)))
    shards, blocks = max(1, -(-n // size)), max(1, -(-asked // config.block))
    early = max(1, int(shards * config.first_wave))
    shard = F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int")
    block = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)).cast("int")
    none = [F.lit(None).cast("double").alias("floor"), F.lit(None).cast("long").alias("floor_id")]
    candidates = rows.select(shard.alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(False).alias("asks"), "vec_id", "vector", *none)
    asking = rows.where(is_query).select(block.alias("block"), "vec_id", "vector")

    def wave(questions: DataFrame, low: int, high: int) -> DataFrame:
        spread = questions.withColumn("shard", F.explode(F.sequence(F.lit(low), F.lit(high - 1))))
        spread = spread.select("shard", "block", F.lit(True).alias("asks"), "vec_id", "vector", "floor", "floor_id")
        mine = candidates.where((F.col("shard") >= low) & (F.col("shard") < high))
        return mine.unionByName(spread).groupBy("shard", "block").applyInArrow(_answer(config), _FOUND)

    found = wave(asking.select("*", *none), 0, early)
    if early < shards:
        found = scratch.keep("first", _best(found, config.k).drop("rank"))
        floors = found.groupBy("query_id").agg(F.count("*").alias("n"), F.min(F.struct("score", F.bitwise_not("vec_id").alias("id"))).alias("last"))
        floors = floors.where(F.col("n") >= config.k).select(F.col("query_id").alias("vec_id"), F.col("last.score").cast("double").alias("floor"), F.bitwise_not(F.col("last.id")).alias("floor_id"))
        found = found.union(wave(asking.join(floors, "vec_id", "left"), early, shards))
    return _best(found, config.k).select("query_id", "rank", "vec_id", "score")
