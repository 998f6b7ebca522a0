"""Graph operators: components, degrees, shortest paths over many graphs at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from atrium.scratch import Scratch


def _neighbour_minimum(pairs: DataFrame, key: str, other: str) -> DataFrame:
    """For each value of ``key`` the smallest of itself and its ``other`` values, keyed by ``-key``.

    The sign change makes the later join shuffle this side once more, so that both of
    its inputs are plain exchanges and adaptive execution may split a hub's partition.
    """
    low = pairs.groupBy(key).agg(F.min(other).alias("_low"))
    return low.select((-F.col(key)).alias("_k"), F.least(F.col(key), F.col("_low")).alias("_low"))


def component_stars(edges: DataFrame, scratch: Scratch, name: str = "stars", max_rounds: int = 60) -> DataFrame:
    """Components of an undirected graph by alternating large-star and small-star rounds.

    ``edges`` holds two integer columns ``a`` and ``b``. Returns ``(node, component)`` for
    every node on an edge between two different nodes; the component is its smallest node.
    A round is one job of partial minima and joins; only a row count and a checksum reach
    the driver. Null ends and self loops are ignored; repeated edges count once.
    """
    spark = scratch.spark
    a, b = F.col("a").cast("long"), F.col("b").cast("long")
    state = edges.where(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct()
    state = scratch.keep(f"{name}-0", state)
    seen = _fingerprint(state)
    for turn in range(1, max_rounds + 1):
        both = state.union(state.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = _neighbour_minimum(both, "a", "b")
        # large star: every larger neighbour of a node is hung on the smallest of its neighbourhood
        large = (
            state.select((-F.col("b")).alias("_k"), F.col("a").alias("_v"))
            .join(low, "_k")
            .select(F.col("_v").alias("a"), F.col("_low").alias("b"))
        )
        large = large.distinct()
        least = _neighbour_minimum(large, "a", "b")
        # small star: the smaller neighbours of a node, and the node, are hung on the smallest of them
        hung = large.select((-F.col("a")).alias("_k"), F.col("b").alias("_v")).join(least, "_k")
        small = hung.select(F.col("_v").alias("a"), F.col("_low").alias("b")).union(
            least.select((-F.col("_k")).alias("a"), F.col("_low").alias("b"))
        )
        following = scratch.keep(f"{name}-{turn}", small.where("a <> b").distinct())
        scratch.drop(f"{name}-{turn - 1}")
        state, now = following, _fingerprint(following)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = state.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("component"))
    return state.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)


def _fingerprint(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.col("b").cast("decimal(38,0)"))).collect()[0]
    return tuple(row)


def contract_chains(links: DataFrame, kept: DataFrame, scratch: Scratch) -> DataFrame:
    """Directed links without the nodes that only lie between two others, at equal least costs between all that stay.

    ``links``: ``venue_id, node, to_id, step, hops``, one for each pair; ``kept``: ``venue_id, node`` of nodes that must stay. A node with
    one or two neighbours goes if its hash is the largest around it, so no two neighbours go in one round; its two links
    become one. Rounds stop when few nodes go; a long corridor shrinks by a fixed share in each.
    """
    total, turn = None, 0
    rank = lambda c: F.xxhash64("venue_id", c)
    while True:
        both = links.select("venue_id", "node", F.col("to_id").alias("other")).union(links.select("venue_id", F.col("to_id").alias("node"), F.col("node").alias("other"))).distinct()
        degree = both.groupBy("venue_id", "node").agg(F.count("*").alias("n"), F.max(rank("other")).alias("around"))
        loose = degree.where("n <= 2").join(kept, ["venue_id", "node"], "left_anti")
        # neighbours that may not go do not compete
        rivals = both.join(loose.select("venue_id", F.col("node").alias("other")), ["venue_id", "other"], "left_semi").groupBy("venue_id", "node").agg(F.max(rank("other")).alias("rival"))
        gone = loose.join(rivals, ["venue_id", "node"], "left").where(F.col("rival").isNull() | (rank("node") > F.col("rival"))).select("venue_id", "node")
        gone = scratch.keep(f"gone-{turn}", gone)
        n = gone.count()
        total = both.select("venue_id", "node").distinct().count() if total is None else total
        if 20 * n < total or not n:
            return links
        into = links.join(gone.select("venue_id", F.col("node").alias("to_id")), ["venue_id", "to_id"], "left_semi")
        out = links.join(gone, ["venue_id", "node"], "left_semi")
        joined = into.select("venue_id", F.col("node").alias("_from"), F.col("to_id").alias("node"), F.col("step").alias("_step"), F.col("hops").alias("_hops")).join(out, ["venue_id", "node"])
        joined = joined.where("_from <> to_id").select("venue_id", F.col("_from").alias("node"), "to_id", (F.col("_step") + F.col("step")).alias("step"), (F.col("_hops") + F.col("hops")).alias("hops"))
        rest = links.join(gone, ["venue_id", "node"], "left_anti").join(gone.select("venue_id", F.col("node").alias("to_id")), ["venue_id", "to_id"], "left_anti")
        merged = rest.unionByName(joined).groupBy("venue_id", "node", "to_id").agg(F.min(F.struct("step", "hops")).alias("s")).select("venue_id", "node", "to_id", "s.*")
        links = scratch.keep(f"links-{turn}", merged)
        total, turn = total - n, turn + 1


def shortest_paths(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """Least cost from ``source`` to ``target`` for all pairs of all venues together.

    ``edges``: ``venue_id, from_id, to_id, cost`` (directed, cost of 0 or more); ``pairs``: ``od_id, venue_id,
    source, target``. Returns ``od_id, cost, hops``; a pair without a path has null in both. Corridors without a source or
    target are made single links first. Each round relaxes the links behind the rows that improved in the last
    one, all searches at once, and drops rows that cost more than their pair's best arrival so far, until none
    improves. Ties go to fewer hops.
    """
    spark = edges.sparkSession
    scratch = Scratch(spark, "paths")
    links = edges.where("from_id <> to_id").groupBy("venue_id", F.col("from_id").alias("node"), "to_id").agg(F.min("cost").cast("double").alias("step")).withColumn("hops", F.lit(1))
    links = scratch.keep("edges", links)
    asked = scratch.keep("pairs", pairs.select("od_id", "venue_id", "source", "target"))
    ends = asked.select("venue_id", F.explode(F.array("source", "target")).alias("node")).distinct()
    links = contract_chains(links, ends, scratch).withColumnRenamed("hops", "_hops")
    state = asked.select("od_id", "venue_id", "target", F.col("source").alias("node"), F.lit(0).cast("double").alias("cost"), F.lit(0).alias("hops"), F.lit(True).alias("fresh"))
    state = scratch.keep("state-0", state)
    turn = 0
    while True:
        turn += 1
        found = state.where("fresh").join(links, ["venue_id", "node"])
        found = found.select("od_id", "venue_id", "target", F.col("to_id").alias("node"), (F.col("cost") + F.col("step")).alias("cost"), (F.col("hops") + F.col("_hops")).alias("hops"), F.lit(True).alias("fresh"))
        arrived = state.where("node = target").groupBy("od_id").agg(F.min("cost").alias("_best"))
        found = found.join(arrived, "od_id", "left").where("_best is null or cost <= _best").drop("_best")
        both = state.withColumn("fresh", F.lit(False)).unionByName(found)
        best = both.groupBy("od_id", "venue_id", "target", "node").agg(F.min(F.struct("cost", "hops", "fresh")).alias("b"))
        state = scratch.keep(f"state-{turn}", best.select("od_id", "venue_id", "target", "node", "b.cost", "b.hops", "b.fresh"))
        scratch.drop(f"state-{turn - 1}")
        if not state.where("fresh").limit(1).count():
            break
    reached = state.where("node = target").select("od_id", "cost", "hops")
    return asked.select("od_id").join(reached, "od_id", "left")
