"""Walking networks: cleaning, checks, differences, edits and export, over many venues at once.

Edges are ``venue_id, from_id, to_id, cost`` with ``path_id, rpath_id`` of the source; nodes are
``venue_id, node_id, ordinal``. Every operator is keyed by venue, so its joins shuffle on (venue, node).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from atrium.functions import scalars
from atrium.operators.graph import component_stars
from atrium.operators.views import add_connections
from atrium.scratch import Scratch


@dataclass(frozen=True)
class RouteProfile:
    """Which edges a traveller may use; ``minute`` is the minute of the day, -1 for any."""

    stairs: bool = True
    escalators: bool = True
    wheelchair: bool = False
    pass_barriers: bool = True
    accessible_only: bool = False
    min_clearance_m: float | None = None
    minute: int = -1


def latest_nodes(junctions: DataFrame) -> DataFrame:
    """One row for each (venue, node): the last by ``pos``. Rows without an id are left out."""
    last = Window.partitionBy("venue_id", "node_id").orderBy(F.col("pos").desc())
    return junctions.where("node_id is not null").withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")


def mapped_nodes(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes whose floor label names an ordinal, and a warning row for each other one."""
    named = nodes.withColumn("ordinal", scalars.floor_to_ordinal(F.col("floor")))
    warned = named.where("ordinal is null").select("venue_id", F.lit("unmapped_floor").alias("code"), F.col("node_id").cast("string").alias("subject"))
    return named.where("ordinal is not null"), warned


def _valid_cost() -> Column:
    return F.coalesce((F.col("cost") >= 0) & ~F.isnan(F.col("cost").cast("double")) & (F.col("cost").cast("double") < F.lit(float("inf"))), F.lit(False))


def invalid_costs(paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Paths with a finite cost of 0 or more, and a warning row for each other one (key: path_id)."""
    fine = _valid_cost()
    warned = paths.where(~fine).select("venue_id", F.lit("invalid_cost").alias("code"), F.col("path_id").cast("string").alias("subject"))
    return paths.where(fine), warned


def _with_ends(paths: DataFrame, nodes: DataFrame) -> tuple[DataFrame, Column]:
    """Paths beside the nodes at their ends, and whether both are there."""
    known = nodes.select("venue_id", F.col("node_id").alias("_node")).distinct()
    end = lambda side: (paths[f"{side}_id"] == F.col(f"_{side}._node")) & (paths.venue_id == F.col(f"_{side}.venue_id"))
    joined = paths.join(known.alias("_from"), end("from"), "left").join(known.alias("_to"), end("to"), "left")
    return joined, F.col("_from._node").isNotNull() & F.col("_to._node").isNotNull()


def dangling_edges(paths: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Paths with both ends among the nodes, and a warning row for each other one."""
    joined, whole = _with_ends(paths, nodes)
    warned = joined.where(~whole).select(paths.venue_id, F.lit("dangling_edge").alias("code"), F.col("path_id").cast("string").alias("subject"))
    return joined.where(whole).select(*[paths[c] for c in paths.columns]), warned


def path_warnings(paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """The warnings of ``invalid_costs``, and of ``dangling_edges`` over the paths that it leaves, in one pass over the paths."""
    joined, whole = _with_ends(paths, nodes)
    code = F.when(~_valid_cost(), "invalid_cost").when(~whole, "dangling_edge")
    return joined.select(paths.venue_id, code.alias("code"), F.col("path_id").cast("string").alias("subject")).where("code is not null")


def edge_ordinals(paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """Add ``ordinal``: that of the path's own floor label, else of its first node."""
    first = nodes.select("venue_id", F.col("node_id").alias("from_id"), F.col("ordinal").alias("_from_ordinal"))
    own = scalars.floor_to_ordinal(F.col("floor"))
    return paths.join(first, ["venue_id", "from_id"], "left").withColumn("ordinal", F.coalesce(own, "_from_ordinal")).drop("_from_ordinal")


def unmatched_levels(nodes: DataFrame, levels: DataFrame) -> DataFrame:
    """Ordinals of nodes that no level of the venue has, with their number of nodes."""
    key = lambda frame: frame.withColumn("ord_key", F.col("ordinal") + F.lit(0.0))
    floors = key(levels).select("venue_id", "ord_key").distinct()
    return key(nodes).join(floors, ["venue_id", "ord_key"], "left_anti").groupBy("venue_id", F.col("ord_key").alias("ordinal")).agg(F.count("*").alias("nodes"))


def collapse_reciprocal(paths: DataFrame) -> DataFrame:
    """Of each exact reverse pair keep the path with the smaller id.

    A reverse pair has ids and ends swapped. Repeated signatures are paired by occurrence (in order
    of cost). Paths without ids stay. ``conflict`` marks paths that share their unordered id pair with
    a path that is not their reverse; they stay as well.
    """
    signature = ["venue_id", "from_id", "to_id", "path_id", "rpath_id"]
    nth = F.row_number().over(Window.partitionBy(*signature).orderBy("cost"))
    numbered = paths.withColumn("occurrence", nth)
    other = numbered.select(
        "venue_id", F.col("to_id").alias("from_id"), F.col("from_id").alias("to_id"), F.col("rpath_id").alias("path_id"), F.col("path_id").alias("rpath_id"), "occurrence", F.lit(True).alias("_paired")
    )
    joined = numbered.join(other, [*signature, "occurrence"], "left")
    kept = joined.where(F.col("_paired").isNull() | (F.col("path_id") <= F.col("rpath_id")) | F.col("path_id").isNull())
    low, high = F.least("path_id", "rpath_id"), F.greatest("path_id", "rpath_id")
    shared = F.count("*").over(Window.partitionBy("venue_id", low, high))
    return kept.withColumn("conflict", F.coalesce((shared > 1) & F.col("path_id").isNotNull(), F.lit(False))).drop("_paired", "occurrence")


def edge_allowed(profile: RouteProfile) -> Column:
    """Whether a traveller may use an edge; an unknown clearance passes, hours are half open and may span midnight."""
    kind = F.coalesce(F.col("vertical"), F.lit(""))
    ok = F.lit(True)
    if profile.wheelchair or not profile.stairs:
        ok = ok & (kind != "stairs")
    if profile.wheelchair or not profile.escalators:
        ok = ok & (kind != "escalator")
    if profile.min_clearance_m is not None:
        ok = ok & F.coalesce(F.col("clearance") >= profile.min_clearance_m, F.lit(True))
    if not profile.pass_barriers:
        ok = ok & (F.coalesce(F.col("barrier"), F.lit(0)) == 0)
    if profile.accessible_only:
        ok = ok & (F.coalesce(F.col("gate"), F.lit(0)) == 0)
    if profile.minute >= 0:
        start, end, now = F.col("start_minute"), F.col("end_minute"), F.lit(profile.minute)
        inside = F.when(start <= end, (now >= start) & (now < end)).otherwise((now >= start) | (now < end))
        ok = ok & ((start < 0) | (end < 0) | inside)
    return ok


def decode_edge_columns(paths: DataFrame) -> DataFrame:
    """Typed traversal columns with defaults; a vertical kind and a vertical category must come together, else all reset."""
    way = F.when(F.col("direction") == 1, "forward").when(F.col("direction") == 2, "reverse").otherwise("both")
    kind = F.when(F.col("edge_kind").isin("normal", "footway", "vertical"), F.col("edge_kind")).otherwise("normal")
    lift = F.when(F.col("vertical").isin("elevator", "escalator", "stairs"), F.col("vertical"))
    whole = (kind == "vertical") == lift.isNotNull()
    return paths.withColumns(
        {
            "travel": way,
            "has_barrier": F.coalesce(F.col("barrier"), F.lit(0)) != 0,
            "has_gate": F.coalesce(F.col("gate"), F.lit(0)) != 0,
            "kind": F.when(whole, kind).otherwise("normal"),
            "lift": F.when(whole, lift),
            "clearance_m": F.when(whole, F.col("clearance")),
            "from_minute": F.coalesce(F.col("start_minute"), F.lit(-1)),
            "until_minute": F.coalesce(F.col("end_minute"), F.lit(-1)),
        }
    )


def degree(edges: DataFrame) -> DataFrame:
    """Connections at each node; a self loop counts once."""
    ends = F.array_distinct(F.array("from_id", "to_id"))
    return edges.select("venue_id", F.explode(ends).alias("node_id")).groupBy("venue_id", "node_id").agg(F.count("*").alias("degree"))


def connection_keys(edges: DataFrame) -> DataFrame:
    """Distinct logical connections: the unordered id pair, else the unordered ends."""
    pair = F.when(F.col("path_id").isNotNull() & F.col("rpath_id").isNotNull(), F.concat_ws(":", F.lit("p"), F.least("path_id", "rpath_id"), F.greatest("path_id", "rpath_id")))
    ends = F.concat_ws(":", F.lit("n"), F.least("from_id", "to_id"), F.greatest("from_id", "to_id"))
    return edges.select("venue_id", F.coalesce(pair, ends).alias("connection_key")).distinct()


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``venue_id, node_id, component``: the smallest node id of the node's undirected component.

    Node ids are integers unique in their venue; a node without edges is a component of its own.
    """
    scratch = Scratch(nodes.sparkSession, "components")
    code = lambda c: F.xxhash64("venue_id", F.col(c).cast("long"))
    stars = component_stars(edges.select(code("from_id").alias("a"), code("to_id").alias("b")), scratch)
    member = nodes.select("venue_id", "node_id", code("node_id").alias("node")).join(stars, "node", "left")
    member = member.withColumn("component", F.coalesce("component", "node"))
    label = member.groupBy("venue_id", "component").agg(F.min("node_id").alias("label"))
    return member.join(label, ["venue_id", "component"]).select("venue_id", "node_id", F.col("label").alias("component"))


def component_sizes(components: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes and floors of each component."""
    return components.join(nodes.select("venue_id", "node_id", "ordinal"), ["venue_id", "node_id"]).groupBy("venue_id", "component").agg(
        F.count("*").alias("size"), F.countDistinct("ordinal").alias("floors")
    )


def connectivity_report(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Per venue: nodes, edges, components, share and floors of the largest (ties: smallest id), isolated nodes."""
    edges = _ends_once(edges)
    components = connected_components(nodes, edges)
    sizes = component_sizes(components, nodes)
    shape = sizes.groupBy("venue_id").agg(
        F.sum("size").alias("nodes"), F.count("*").alias("components"), F.count_if(F.col("size") == 1).alias("isolated"), F.max(F.struct("size", (-F.col("component")).alias("c"), "floors")).alias("largest")
    )
    counted = edges.groupBy("venue_id").agg(F.count("*").alias("edges"))
    share = F.round(F.col("largest.size") / F.col("nodes"), 6).alias("largest_share")
    return shape.join(counted, "venue_id", "left").select("venue_id", "nodes", F.coalesce("edges", F.lit(0)).alias("edges"), "components", share, F.col("largest.floors").alias("floors_in_largest"), "isolated")


def _ends_once(edges: DataFrame) -> DataFrame:
    """The ends of the edges as a table: what makes the edges runs once, however often they are read."""
    return Scratch(edges.sparkSession, "ends").keep("edges", edges.select("venue_id", "from_id", "to_id"))


def network_qa(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Findings of each venue: more than one component, and nodes without an edge; by code, then subject."""
    edges = _ends_once(edges)
    found = connected_components(nodes, edges).groupBy("venue_id").agg(F.countDistinct("component").alias("components"))
    split = found.where("components > 1").select("venue_id", F.lit("disconnected_component").alias("code"), F.col("components").cast("string").alias("subject"))
    at = degree(edges).select("venue_id", "node_id")
    alone = nodes.join(at, ["venue_id", "node_id"], "left_anti").select("venue_id", F.lit("isolated_node").alias("code"), F.col("node_id").cast("string").alias("subject"))
    return split.union(alone)


def network_profile(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Counts in long form: edge kinds, degrees (isolated ones as 0) and nodes of each floor."""
    kinds = edges.groupBy("venue_id", F.lit("edge_kind").alias("measure"), F.col("edge_kind").alias("bucket")).agg(F.count("*").alias("n"))
    degrees = nodes.select("venue_id", "node_id").join(degree(edges), ["venue_id", "node_id"], "left")
    degrees = degrees.groupBy("venue_id", F.lit("degree").alias("measure"), F.coalesce("degree", F.lit(0)).cast("string").alias("bucket")).agg(F.count("*").alias("n"))
    floors = nodes.groupBy("venue_id", F.lit("floor").alias("measure"), F.col("ordinal").cast("int").cast("string").alias("bucket")).agg(F.count("*").alias("n"))
    return kinds.union(degrees).union(floors)


def shape_profile(nodes: DataFrame, edges: DataFrame, lengths: DataFrame) -> DataFrame:
    """Further counts in long form: components by size (isolated nodes as 1), and edges with a dead end by whole metres of length (10 and more as one).

    ``lengths``: ``venue_id, path_id, metres``.
    """
    found = connected_components(nodes, edges).groupBy("venue_id", "component").agg(F.count("*").alias("size"))
    sizes = found.groupBy("venue_id", F.lit("component_size").alias("measure"), F.col("size").cast("string").alias("bucket")).agg(F.count("*").alias("n"))
    ends = degree(edges).where("degree = 1").select("venue_id", "node_id")
    at = lambda end: edges.select("venue_id", F.col(end).alias("node_id"), "path_id").join(ends, ["venue_id", "node_id"], "left_semi").select("venue_id", "path_id")
    leaves = at("from_id").union(at("to_id")).distinct().join(lengths, ["venue_id", "path_id"])
    bucket = F.when(F.col("metres") >= 10, "10+").otherwise(F.floor("metres").cast("string"))
    return sizes.union(leaves.groupBy("venue_id", F.lit("leaf_metres").alias("measure"), bucket.alias("bucket")).agg(F.count("*").alias("n")))


def edit_junctions(nodes: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Junctions after bulk edits (``venue_id, request_id, op, node_id, ordinal, lon, lat``), and the refused edits.

    ``add`` makes a junction with an id after the venue's highest, in order of request; of several ``move`` edits of a junction the last
    counts; ``delete`` wins over moves. Refused are moves and deletions of unknown junctions, and places off the globe. Paths of
    deleted junctions go with ``apply_network_edits``.
    """
    fine = F.coalesce(F.col("lon").between(-180, 180) & F.col("lat").between(-90, 90), F.lit(False))
    known = nodes.select("venue_id", "node_id", F.lit(True).alias("_known"))
    rows = edits.join(known, ["venue_id", "node_id"], "left")
    reason = F.when((F.col("op") != "add") & F.col("_known").isNull(), "unknown_junction").when((F.col("op") != "delete") & ~fine, "off_the_globe")
    rows = rows.withColumn("reason", reason)
    good = rows.where("reason is null")
    last = good.where("op = 'move'").groupBy("venue_id", "node_id").agg(F.max_by(F.struct("lon", "lat"), "request_id").alias("to"))
    gone = good.where("op = 'delete'").select("venue_id", "node_id")
    moved = nodes.join(gone, ["venue_id", "node_id"], "left_anti").join(last, ["venue_id", "node_id"], "left")
    stay = moved.select("venue_id", "node_id", "ordinal", F.coalesce("to.lon", "lon").alias("lon"), F.coalesce("to.lat", "lat").alias("lat"))
    top = nodes.groupBy("venue_id").agg(F.max("node_id").alias("_top"))
    number = F.row_number().over(Window.partitionBy("venue_id").orderBy("request_id"))
    added = good.where("op = 'add'").withColumn("_n", number).join(top, "venue_id", "left").select("venue_id", (F.coalesce("_top", F.lit(0)) + F.col("_n")).alias("node_id"), "ordinal", "lon", "lat")
    return stay.unionByName(added), rows.where("reason is not null").select("venue_id", "request_id", "reason")


def network_diff(base_nodes: DataFrame, nodes: DataFrame, base_edges: DataFrame, edges: DataFrame) -> DataFrame:
    """Per venue: junctions added, moved and deleted, connections added and deleted."""
    old = base_nodes.select("venue_id", "node_id", F.struct("lon", "lat").alias("was"))
    new = nodes.select("venue_id", "node_id", F.struct("lon", "lat").alias("now"))
    points = old.join(new, ["venue_id", "node_id"], "full_outer").groupBy("venue_id").agg(
        F.count_if(F.col("was").isNull()).alias("junctions_added"), F.count_if(F.col("was") != F.col("now")).alias("junctions_moved"), F.count_if(F.col("now").isNull()).alias("junctions_deleted")
    )
    left = connection_keys(base_edges).withColumn("was", F.lit(True))
    right = connection_keys(edges).withColumn("now", F.lit(True))
    lines = left.join(right, ["venue_id", "connection_key"], "full_outer").groupBy("venue_id").agg(
        F.count_if(F.col("was").isNull()).alias("connections_added"), F.count_if(F.col("now").isNull()).alias("connections_deleted")
    )
    return points.join(lines, "venue_id", "full_outer").na.fill(0)


def connections_inside(edges: DataFrame, chosen: DataFrame) -> DataFrame:
    """Edges with both ends among the chosen nodes."""
    first = chosen.select("venue_id", F.col("node_id").alias("from_id"))
    second = chosen.select("venue_id", F.col("node_id").alias("to_id"))
    return edges.join(first, ["venue_id", "from_id"], "left_semi").join(second, ["venue_id", "to_id"], "left_semi")


def connections_along(edges: DataFrame, sequence: DataFrame) -> DataFrame:
    """Edges, in either direction, between consecutive nodes of ``venue_id, position, node_id``."""
    step = Window.partitionBy("venue_id").orderBy("position")
    steps = sequence.withColumn("_next", F.lead("node_id").over(step)).where("_next is not null")
    steps = steps.select("venue_id", F.least("node_id", "_next").alias("_low"), F.greatest("node_id", "_next").alias("_high")).distinct()
    ends = edges.withColumns({"_low": F.least("from_id", "to_id"), "_high": F.greatest("from_id", "to_id")})
    return ends.join(steps, ["venue_id", "_low", "_high"], "left_semi").drop("_low", "_high")


def _pair() -> Column:
    """The two ids of a connection, the smaller first; null where one is missing or both are one."""
    return F.when(F.col("path_id") != F.col("rpath_id"), F.struct(F.least("path_id", "rpath_id").alias("low"), F.greatest("path_id", "rpath_id").alias("high")))


def delete_connections(edges: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Paths without the connections that ``venue_id, request_id, path_id, rpath_id`` name, ids in either order, and the requests that name none."""
    have, asked = edges.withColumn("_pair", _pair()), wanted.withColumn("_pair", _pair())
    left = have.join(asked.select("venue_id", "_pair"), ["venue_id", "_pair"], "left_anti").select(*edges.columns)
    lost = asked.join(have.select("venue_id", "_pair"), ["venue_id", "_pair"], "left_anti")
    return left, lost.select("venue_id", "request_id", F.lit("unknown_connection").alias("reason"))


def path_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Connections at each node (``venue_id, node_id, path_count``): the rows of one id pair are one, by the ends of its smallest row, a self loop counts once."""
    ends = F.struct(F.least("from_id", "to_id").alias("low"), F.greatest("from_id", "to_id").alias("high"))
    keyed = edges.select("venue_id", _pair().alias("_pair"), F.when(_pair().isNull(), ends).alias("_ends"), F.struct("path_id", "from_id", "to_id").alias("_row"))
    once = keyed.groupBy("venue_id", "_pair", "_ends").agg(F.min("_row").alias("_row")).select("venue_id", "_row.*")
    return nodes.select("venue_id", "node_id").join(degree(once), ["venue_id", "node_id"], "left").select("venue_id", "node_id", F.coalesce("degree", F.lit(0)).alias("path_count"))


#: What a new path has in columns of the source.
PATH_DEFAULTS = {"barrier": 0, "gate": 0, "start_minute": -1, "end_minute": -1, "edge_kind": "normal"}


def apply_network_edits(nodes: DataFrame, edges: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A network after bulk edits: junctions with their ``path_count``, paths, and the refused edits ``venue_id, request_id, reason``.

    ``edits``: ``venue_id, request_id, op`` with ``node_id, ordinal, lon, lat`` for ``add``, ``move`` and ``delete`` of junctions (as
    ``edit_junctions``), ``path_id, rpath_id`` for ``disconnect`` and ``from_id, to_id`` for ``connect``. Junctions come first, then
    connections go, by name or with a junction, and last new ones join what is there by then (as ``views.add_connections``): a row
    each way, costing the millimetres between the ends. Where paths have ``points``, their ends go with moved junctions.
    """
    scratch = Scratch(nodes.sparkSession, "edits")
    nodes, edges, edits = scratch.keep("nodes", nodes), scratch.keep("edges", edges), scratch.keep("edits", edits)
    of = lambda *ops: edits.where(F.col("op").isin(*ops))
    junctions, refused = edit_junctions(nodes, of("add", "move", "delete").select("venue_id", "request_id", "op", "node_id", "ordinal", "lon", "lat"))
    junctions = scratch.keep("junctions", junctions)
    kept, unnamed = delete_connections(edges, of("disconnect").select("venue_id", "request_id", "path_id", "rpath_id"))
    # ends that were no junction before stay as they are
    gone = nodes.select("venue_id", "node_id").join(junctions, ["venue_id", "node_id"], "left_anti")
    for end in ("from_id", "to_id"):
        kept = kept.join(gone.select("venue_id", F.col("node_id").alias(end)), ["venue_id", end], "left_anti")
    kept = kept.select(*edges.columns)
    if "points" in edges.columns:
        moves = of("move").join(refused, ["venue_id", "request_id"], "left_anti").select("venue_id", "node_id").distinct()
        kept = _dragged(kept, junctions.join(moves, ["venue_id", "node_id"], "left_semi"))
    kept = scratch.keep("kept", kept)
    at = lambda end: junctions.select("venue_id", F.col("node_id").alias(end), F.struct("lon", "lat").alias(f"_{end}"))
    wanted = of("connect").select("venue_id", "request_id", "from_id", "to_id")
    placed = wanted.join(at("from_id"), ["venue_id", "from_id"], "left").join(at("to_id"), ["venue_id", "to_id"], "left")
    metres = scalars.haversine_m(F.col("_from_id.lon"), F.col("_from_id.lat"), F.col("_to_id.lon"), F.col("_to_id.lat"))
    added, unlinked = add_connections(junctions, kept, placed.withColumn("cost", F.round(metres * 1000).cast("bigint")))
    row = lambda a, b, p, r, x, y: F.struct(F.col(a).alias("from_id"), F.col(b).alias("to_id"), F.col(p).alias("path_id"), F.col(r).alias("rpath_id"), F.array(x, y).alias("points"))
    lined = added.join(at("from_id"), ["venue_id", "from_id"]).join(at("to_id"), ["venue_id", "to_id"])
    both = F.array(row("from_id", "to_id", "path_id", "rpath_id", "_from_id", "_to_id"), row("to_id", "from_id", "rpath_id", "path_id", "_to_id", "_from_id"))
    new = lined.select("venue_id", "cost", F.explode(both).alias("r")).select("venue_id", "cost", "r.*", *[F.lit(v).alias(c) for c, v in PATH_DEFAULTS.items()])
    paths = kept.unionByName(scratch.keep("new", new.select(*[c for c in new.columns if c in edges.columns])), allowMissingColumns=True)
    return junctions.join(path_counts(junctions, paths), ["venue_id", "node_id"]), paths, refused.union(unnamed).union(unlinked)


def _dragged(edges: DataFrame, moved: DataFrame) -> DataFrame:
    """Edges whose first and last points are where their moved junctions are; the points between stay."""
    to = lambda end: moved.select("venue_id", F.col("node_id").alias(end), F.struct("lon", "lat").alias(f"_{end}"))
    rows = edges.join(to("from_id"), ["venue_id", "from_id"], "left").join(to("to_id"), ["venue_id", "to_id"], "left")
    last = F.size("points") - 1
    points = F.transform("points", lambda p, k: F.coalesce(F.when(k == last, F.col("_to_id")), F.when(k == 0, F.col("_from_id")), p))
    return rows.withColumn("points", points).select(*edges.columns)


def export_network(nodes: DataFrame, edges: DataFrame, floor_height_m: float = 4.0, walk_speed: float = 1.4) -> DataFrame:
    """Forward and reverse rows with consecutive ids for every edge, in order of (from, to, path_id).

    Vertical edges swap their end floors in the reverse row. ``travel_time`` is whole seconds of
    walking the cost in millimetres; altitudes are ordinals times the floor height.
    """
    ends = nodes.select("venue_id", "node_id", "ordinal", scalars.ordinal_to_floor_label(F.col("ordinal")).alias("label"))
    a = ends.select("venue_id", F.col("node_id").alias("from_id"), F.col("ordinal").alias("a_ordinal"), F.col("label").alias("a_floor"))
    b = ends.select("venue_id", F.col("node_id").alias("to_id"), F.col("ordinal").alias("b_ordinal"), F.col("label").alias("b_floor"))
    both = edges.join(a, ["venue_id", "from_id"]).join(b, ["venue_id", "to_id"])
    n = F.row_number().over(Window.partitionBy("venue_id").orderBy("from_id", "to_id", "path_id"))
    crosses = F.col("a_floor") != F.col("b_floor")
    seconds = F.round(F.col("cost") / 1000.0 / walk_speed).cast("bigint")

    def row(first: str, second: str, x: str, y: str, own: Column, other: Column) -> Column:
        return F.struct(
            F.col(first).alias("fnodeid"), F.col(second).alias("tnodeid"), own.alias("pathid"), other.alias("rpathid"), F.col("cost"), seconds.alias("traveltime"),
            F.when(crosses, F.col(f"{x}_floor")).alias("ffloor"), F.when(crosses, F.col(f"{y}_floor")).alias("tofloor"), (F.col(f"{x}_ordinal") * floor_height_m).alias("altitude"),
        )

    numbered = both.withColumn("_n", n.cast("bigint"))
    odd, even = 2 * F.col("_n") - 1, 2 * F.col("_n")
    rows = numbered.select("venue_id", F.explode(F.array(row("from_id", "to_id", "a", "b", odd, even), row("to_id", "from_id", "b", "a", even, odd))).alias("r"))
    return rows.select("venue_id", "r.*")
