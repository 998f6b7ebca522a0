"""Exact range join of embeddings in a metric space, partitioned by pivots.

For unit vectors a cosine of c is a Euclidean distance of sqrt(2 - 2c), so near-duplicate
embeddings are a range join. A cell with too many vectors draws pivots from among its own, and every
vector's home is the nearest one. If a vector has a partner within the range in another cell, the
triangle inequality puts it within that range of the plane between the two pivots and within
the cell's radius plus the range of its pivot; only such a vector, and no neighbour of it, is copied there, and
only into the cell of the smaller number. Cells are cut again in the same way until they are small, each by itself; a bit
for each round marks copies, so that two vectors are compared in one cell only. Where pivots would
copy vectors more often than ``copies`` times on average, the cell is joined in pairs of blocks instead.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, FloatType

from atrium.llm import textbuf
from atrium.operators.graph import component_stars
from atrium.scratch import Scratch


@dataclass(frozen=True)
class MetricJoinConfig:
    """Cells of more than ``cell`` vectors are cut by up to ``pivots`` pivots; ``block`` bounds a side of a task.

    Without ``cell`` it follows the table: twice the square root of its different vectors, 32 to ``block``.
    A round of cuts may copy each vector ``copies`` times on average; ``rounds`` bounds the rounds (a cell
    that is still too large is then joined in blocks).
    """

    cosine: float = 0.95
    cell: int | None = None
    pivots: int = 64
    copies: float = 4.0
    rounds: int = 9
    block: int = 4096


def _keyed(vectors: DataFrame) -> DataFrame:
    """All rows with their vector and a key of its numbers; both null for an unusable one."""
    kind = vectors.schema["embedding"].dataType
    single = isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType)
    v = F.col("embedding").cast("array<float>" if single else "array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    fine = v.isNotNull() & F.col("vec_id").isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0.0)
    # -0.0 is 0.0
    zero = F.lit(0.0).cast("float" if single else "double")
    known = vectors.select("vec_id", F.when(fine, F.transform(v, lambda x: F.when(x == zero, zero).otherwise(x))).alias("vector"))
    return known.withColumn("key", F.sha2(F.to_json("vector"), 256))


def _unit(rows: np.ndarray) -> np.ndarray:
    array = rows.astype(np.float64)
    array /= np.abs(array).max(axis=1, keepdims=True)  # no overflow or underflow in the squares
    return array / np.linalg.norm(array, axis=1, keepdims=True)


def _units(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return _unit(lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), dim))


def link_block(a: np.ndarray, b: np.ndarray | None, cosine: float):
    """Links of two blocks of unit vectors in steps: first row of the step, and a mask (rows of the step, rows of b).

    Without ``b`` the pairs of one block, each once. Products in single precision decide where they are
    farther from the threshold than their error can be; doubles decide on the rest.
    """
    other = a if b is None else b
    doubt = np.float32(4e-7 * a.shape[1] + 1e-5)
    high = np.ascontiguousarray(other.astype(np.float32).T)
    for start in range(0, len(a), 512):
        product = a[start : start + 512].astype(np.float32) @ high
        linked = product >= np.float32(cosine)
        i, j = np.nonzero(np.abs(product - np.float32(cosine)) <= doubt)
        for k in range(0, len(i), 1 << 16):
            x, y = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
            linked[x, y] = np.einsum("ij,ij->i", a[x + start], other[y]) >= cosine
        if b is None:
            linked &= np.arange(start, start + len(linked))[:, None] < np.arange(len(other))[None, :]
        yield start, linked


def targets(rows: np.ndarray, homes: np.ndarray, pivots: np.ndarray, extents: np.ndarray, reach: float) -> np.ndarray:
    """Mask (rows, pivots): the cells that each row goes to, its own and those of smaller number that may hold a partner.

    A partner lies on the other side of the plane between the pivots, so a row is within ``reach`` of that plane; and it
    lies within the other cell's radius (``extents``; negative: no vector) of its pivot.
    """
    square = np.maximum(2.0 - 2.0 * (rows @ pivots.T), 0.0)
    close = square[np.arange(len(rows)), homes]
    gaps = np.maximum(np.sqrt(np.maximum(2.0 - 2.0 * (pivots @ pivots.T), 0.0)), 1e-12)
    near = (square - close[:, None]) <= 2.0 * reach * gaps[homes] + 1e-9
    near &= np.sqrt(square) <= extents[None, :] + reach + 1e-9
    near &= (extents >= 0)[None, :] & (np.arange(len(pivots))[None, :] < homes[:, None])
    near[np.arange(len(rows)), homes] = True
    return near


def _confirm(config: MetricJoinConfig):
    def run(table: pa.Table) -> pa.Table:
        table = table.take(pa.array(np.lexsort((table.column("cid").to_numpy(), table.column("own").to_numpy()))))
        dim, low, high = (table.column(c)[0].as_py() for c in ("dim", "low", "high"))
        own, cid, rep, size, copied = (table.column(c).to_numpy() for c in ("own", "cid", "rep", "size", "copied"))
        unit = _units(table.column("vector"), dim)
        edge = int(np.searchsorted(own, high)) if low < high else len(own)
        left, right = slice(0, edge), slice(edge, None) if low < high else slice(0, edge)
        links, label = np.zeros(len(cid), np.int64), np.arange(len(cid))
        some_copied = bool(copied.any())
        for start, linked in link_block(unit[left], unit[right] if low < high else None, config.cosine):
            if some_copied:
                linked &= (copied[left][start : start + len(linked), None] & copied[right][None, :]) == 0
            i, j = np.nonzero(linked)
            links[left][start : start + len(linked)] += np.bincount(i, size[right][j], len(linked)).astype(np.int64)
            links[right] += np.bincount(j, size[left][start + i], linked.shape[1]).astype(np.int64)
            # the smallest row of a component so far is its label
            for i in np.flatnonzero(linked.any(axis=1)).tolist():
                near = label[right][linked[i]]
                mine = label[left][start + i]
                if (near != mine).any():
                    both = np.unique(np.append(near, mine))
                    label[np.isin(label, both)] = both[0]
        some = np.flatnonzero(links)
        return pa.table({"cid": pa.array(cid[some]), "rep": pa.array(rep[some]), "links": pa.array(links[some]), "up": pa.array(rep[label[some]])})

    return run


def _placed(table: pa.Table, pivots: pa.Table) -> pa.Table:
    if not table.num_rows:
        return table.append_column("home", pa.array([], pa.int32())).append_column("far", pa.array([], pa.float64()))
    dim = table.column("dim")[0].as_py()
    unit, centre = _units(table.column("vector"), dim), _units(pivots.column("pivot"), dim)[np.argsort(pivots.column("number").to_numpy())]
    product = unit @ centre.T
    home = product.argmax(axis=1)
    far = np.sqrt(np.maximum(2.0 - 2.0 * product[np.arange(len(home)), home], 0.0))
    return table.append_column("home", pa.array(home.astype(np.int32))).append_column("far", pa.array(far))


def _routed(reach: float):
    def run(table: pa.Table, pivots: pa.Table) -> pa.Table:
        if not table.num_rows:
            return table.append_column("targets", pa.array([], pa.list_(pa.int32())))
        dim, order = table.column("dim")[0].as_py(), np.argsort(pivots.column("number").to_numpy())
        centre, extents = _units(pivots.column("pivot"), dim)[order], pivots.column("extent").to_numpy()[order]
        homes = table.column("home").to_numpy()
        found = targets(_units(table.column("vector"), dim), homes, centre, extents, reach)
        ends = np.concatenate([[0], np.cumsum(found.sum(axis=1))]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.nonzero(found)[1].astype(np.int32)))
        return table.append_column("targets", lists)

    return run


_SLOT = 8192  # vectors that a task places at once
_CARRIED = ("dim", "cell", "cid", "rep", "size", "copied", "vector")


def _cut(rows: DataFrame, scratch: Scratch, config: MetricJoinConfig, turn: int, reach: float) -> tuple[DataFrame, DataFrame | None]:
    """Cells that are ready to be joined, with ``blocks``, and the vectors of those that were cut, in new cells."""
    counts = scratch.keep(f"counts-{turn}", rows.groupBy("dim", "cell").agg(F.count("*").alias("n")))
    large = counts.where(F.col("n") > config.cell)
    small = _keyed_by_cell(counts.where(F.col("n") <= config.cell).withColumn("blocks", F.lit(1)), "blocks")
    done = _with_cell(rows, small)
    if turn == config.rounds or not large.limit(1).count():
        big = large.withColumn("blocks", F.ceil(F.col("n") / config.block).cast("int"))
        return done.unionByName(_with_cell(rows, _keyed_by_cell(big, "blocks"))), None
    dealt = _with_cell(rows, _keyed_by_cell(large, "n"))
    drawn = dealt.withColumn("_h", F.pmod(F.xxhash64("cid", F.lit(turn)), F.col("n"))).where(F.col("_h") < 4 * config.pivots)
    by_cell = Window.partitionBy("dim", "cell").orderBy("_h", "cid")
    pivots = drawn.withColumn("number", F.row_number().over(by_cell) - 1).where(F.col("number") < config.pivots).select("dim", "cell", "number", F.col("vector").alias("pivot"), "n")
    pivots = scratch.keep(f"pivots-{turn}", pivots)
    slots = F.ceil(F.col("n") / F.lit(_SLOT)).cast("int")
    dealt = dealt.withColumn("slot", F.pmod(F.xxhash64("cid", F.lit(-1)), slots).cast("int"))
    in_slots = lambda f: f.withColumn("slot", F.explode(F.sequence(F.lit(0), slots - 1))).drop("n")
    key = ["dim", "cell", "slot"]
    carried = dealt.select(*_CARRIED, "slot", "n")
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in carried.schema)
    placed = carried.groupBy(*key).cogroup(in_slots(pivots).groupBy(*key)).applyInArrow(_placed, f"{kind}, home int, far double")
    placed = scratch.keep(f"placed-{turn}", placed)
    extents = placed.groupBy("dim", "cell", F.col("home").alias("number")).agg(F.max("far").alias("extent"))
    about = pivots.join(extents, ["dim", "cell", "number"], "left").fillna(-1.0, ["extent"])
    routed = placed.groupBy(*key).cogroup(in_slots(about).groupBy(*key)).applyInArrow(_routed(reach), f"{kind}, home int, far double, targets array<int>")
    routed = scratch.keep(f"routed-{turn}", routed)
    scratch.drop(f"placed-{turn}")
    worth = routed.groupBy("dim", "cell").agg(F.sum(F.size("targets")).alias("t"), F.count("*").alias("n"), F.countDistinct("home").alias("split"))
    # one cell is no cut; too many copies cost more than pairs of blocks
    worth = worth.withColumn("blocks", F.when((F.col("t") <= config.copies * F.col("n")) & (F.col("split") > 1), F.lit(0)).otherwise(F.ceil(F.col("n") / config.block).cast("int")))
    worth = scratch.keep(f"worth-{turn}", worth)
    ready = _with_cell(routed.select(*_CARRIED), _keyed_by_cell(worth.where("blocks > 0"), "blocks"))
    again = _with_cell(routed.select(*_CARRIED, "home", "targets"), _keyed_by_cell(worth.where("blocks = 0"), "blocks")).withColumn("target", F.explode("targets"))
    copied = F.when(F.col("target") == F.col("home"), F.col("copied")).otherwise(F.col("copied").bitwiseOR(F.lit(1 << turn).cast("long")))
    again = again.select("dim", (F.col("cell") * (config.pivots + 1) + F.col("target") + 1).alias("cell"), "cid", "rep", "size", copied.alias("copied"), "vector")
    return done.unionByName(ready), scratch.keep(f"rows-{turn + 1}", again)


def _keyed_by_cell(cells: DataFrame, *columns: str) -> DataFrame:
    return cells.select((-F.col("dim")).alias("_d"), (-F.col("cell")).alias("_c"), *columns)


def _with_cell(rows: DataFrame, cells: DataFrame) -> DataFrame:
    """Join figures of cells; both sides are plain exchanges, so that adaptive execution may split a large cell."""
    return rows.withColumns({"_d": -F.col("dim"), "_c": -F.col("cell")}).join(cells, ["_d", "_c"]).drop("_d", "_c")


def join_embeddings(vectors: DataFrame, config: MetricJoinConfig = MetricJoinConfig()) -> DataFrame:
    """Link all vectors with a cosine of ``config.cosine`` or more; one row for each input row.

    Reads ``vec_id`` (integer) and ``embedding``; returns ``vec_id, n_links, component_id, kept``:
    the number of other rows linked directly, the smallest vec_id reachable, and whether it is the
    row's own. Vectors that are null, empty, zero or hold null or non-finite components, and rows
    with a null vec_id, link with nothing (null id: component null, kept). Vectors of different
    lengths never link. Equal vectors are one class, whose rows all link with one another; rows that repeat
    a vec_id count as rows of their own. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "metric")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    every = scratch.keep("keyed", _keyed(rows))
    keyed = every.where("key is not null")
    classes = keyed.groupBy("key").agg(F.min("vec_id").alias("rep"), F.count("*").alias("size"))
    # rows that repeat an id with another vector would share a node; the key tells classes apart
    first = keyed.select("key", F.col("vec_id").alias("rep"), "vector").dropDuplicates(["key", "rep"])
    chosen = classes.join(first, ["key", "rep"]).withColumns({"dim": F.size("vector"), "cid": F.monotonically_increasing_id()})
    chosen = scratch.keep("classes", chosen)
    if config.cell is None:
        config = replace(config, cell=min(config.block, max(32, 2 * isqrt(chosen.count()))))
    reach = float(np.sqrt(max(2.0 - 2.0 * config.cosine, 0.0))) + 1e-9
    rows = chosen.select("dim", F.lit(0).cast("long").alias("cell"), "cid", "rep", "size", F.lit(0).cast("long").alias("copied"), "vector")
    turn, ready = 0, None
    while rows is not None:
        done, rows = _cut(rows, scratch, config, turn, reach)
        ready = done if ready is None else ready.unionByName(done)
        turn += 1
    own = F.pmod(F.xxhash64("cid", F.lit(-2)), F.col("blocks")).cast("int")
    dealt = ready.withColumn("own", own).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    dealt = dealt.select("dim", "cell", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "cid", "rep", "size", "copied", "vector")
    found = dealt.groupBy("dim", "cell", "low", "high").applyInArrow(_confirm(config), "cid long, rep long, links long, up long")
    found = scratch.keep("found", found)
    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    linked = component_stars(found.select(F.col("rep").alias("a"), F.col("up").alias("b")), scratch, "components")
    named = (
        chosen.select("cid", "key", "rep", "size")
        .join(links, "cid", "left")
        .join(linked, F.col("rep") == F.col("node"), "left")
        .select(F.reverse("key").alias("_k"), (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    )
    part = keyed.select("vec_id", F.reverse("key").alias("_k")).join(named, "_k").select("vec_id", "n_links", "component_id")
    rest = every.where("key is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return part.union(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
