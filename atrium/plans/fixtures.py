"""Venue tables that Spark derives from the given tables, written once for Spark and for SQL oracles.

Each definition is a SELECT in the common part of both dialects. ``//`` is integer division (``div`` in
Spark), ``SHA[x]SHA`` a hexadecimal SHA-256; arithmetic is on integers with one division at the end, so both engines get equal bits.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE = frozenset("region nation customer supplier part orders lineitem events documents".split())

LON = "(27953200 + {i}) / 200000.0e0"
LAT = "(7136000 + {j}) / 200000.0e0"


def lon(i: str) -> str:
    return LON.format(i=i)


def lat(j: str) -> str:
    return LAT.format(j=j)


_FLOOR = "case when {o} >= 0 then 'F' || cast({o} + 1 as varchar(9)) else 'B' || cast(-({o}) as varchar(9)) end"

#: Name of a derived table: its SELECT. Names in braces are the tables it reads.
FIXTURES: dict[str, str] = {
    "fx_levels": f"""
        select venue_id, level_id, cast(o as double) as ordinal, o as ordinal_int, {_FLOOR.format(o="o")} as short_name,
               case when n_nationkey % 3 = 0 then o * 4.5e0 end as elevation,
               case when n_nationkey % 4 <> 0 then n_name end as label_en, case when n_nationkey % 4 = 0 then n_name end as label_ja,
               n_nationkey as pos
        from (select 'V' || cast(n_regionkey as varchar(9)) as venue_id, 'L' || cast(n_nationkey as varchar(9)) as level_id, n_nationkey, n_name,
                     row_number() over (partition by n_regionkey order by n_nationkey) - 3 as o from {{nation}})""",
    "fx_units": """
        select l.venue_id, 'U' || cast(k as varchar(9)) as unit_id, k, l.level_id, l.ordinal, c as col, r as row_no,
               case when s <= 3 then 'walkway' when s = 4 then 'corridor' when s = 5 then 'room' when s = 6 then 'elevator'
                    when s = 7 then 'escalator' when s = 8 then 'stairs' end as category,
               case when k % 2 = 0 then 2.5e0 + (k % 3) end as height, 8 * c as i0, 8 * c + 8 as i1, 8 * r as j0, 8 * r + 8 as j1
        from (select cast(p_partkey as bigint) as k, 'L' || cast(p_partkey % 25 as varchar(9)) as level_id, p_size % 10 as s,
                     (p_partkey // 25) % 10 as c, (p_partkey // 25) // 10 as r from {part}) p
        join {fx_levels} l on l.level_id = p.level_id""",
    "fx_nodes": f"""
        select n.venue_id, n.node_id, n.level_id, n.ordinal, n.i, n.j, {lon("n.i")} as lon, {lat("n.j")} as lat, n.rn,
               case when n.node_id % 97 = 0 then 'R' else n.short_name end as floor,
               case when n.node_id % 7 <> 0 then n.ordinal * 4.2e0 + (n.node_id % 5) * 0.1e0 end as altitude
        from (select l.venue_id, k as node_id, l.level_id, l.ordinal, l.short_name, 2 * ((k * 37 + k // 396) % 44) + 1 as i, 2 * ((k * 53) % 36) + 1 as j,
                     row_number() over (partition by l.level_id order by k) as rn
              from (select cast(c_custkey as bigint) as k, 'L' || cast(c_nationkey as varchar(9)) as level_id from {{customer}}) c
              join {{fx_levels}} l on l.level_id = c.level_id) n""",
    "fx_paths": """
        select f.venue_id, p.k as order_key, c.variant,
               case when c.variant = 1 then t.to_id else p.from_id end as from_id,
               case when c.variant = 1 then p.from_id when p.k % 103 = 0 and c.variant = 0 then -1 when c.variant = 2 then t.other_id else t.to_id end as to_id,
               case when p.k % 107 = 0 then -1 else 1000 + (p.k * 7919) % 9000 end as cost,
               case when c.variant = 1 then 2 * p.k + 1 else 2 * p.k end as path_id,
               case when c.variant = 1 then 2 * p.k else 2 * p.k + 1 end as rpath_id,
               case when p.k % 10 in (1, 2) then cast(p.k % 10 as int) end as direction,
               case when p.k % 29 = 0 then 1 else 0 end as barrier, case when p.k % 31 = 0 then 1 else 0 end as gate,
               case when p.k % 13 = 0 then 540 when p.k % 17 = 0 then 1320 else -1 end as start_minute,
               case when p.k % 13 = 0 then 1320 when p.k % 17 = 0 then 300 else -1 end as end_minute,
               case when p.k % 60 = 0 then 'vertical' when p.k % 5 = 0 then 'footway' else 'normal' end as edge_kind,
               case when p.k % 60 = 0 then (case p.k % 3 when 0 then 'elevator' when 1 then 'stairs' else 'escalator' end) end as vertical,
               case when p.k % 4 = 0 and p.k % 3 = 0 then (p.k % 30) / 10.0e0 end as clearance
        from (select cast(o_orderkey as bigint) as k, cast(o_custkey as bigint) as from_id from {orders}) p
        join {fx_nodes} f on f.node_id = p.from_id
        join (select level_id, count(*) as cnt from {fx_nodes} group by level_id) m on m.level_id = f.level_id
        join (select a.order_key, b.node_id as to_id, d.node_id as other_id
              from (select cast(o_orderkey as bigint) as order_key, n.venue_id, n.level_id, n.ordinal, n.rn, z.cnt
                    from {orders} join {fx_nodes} n on n.node_id = o_custkey join (select level_id, count(*) as cnt from {fx_nodes} group by level_id) z on z.level_id = n.level_id) a
              join {fx_nodes} b on b.venue_id = a.venue_id
                   and ((a.order_key % 60 <> 0 and b.level_id = a.level_id and b.rn = (a.rn + a.order_key % 3) % a.cnt + 1)
                     or (a.order_key % 60 = 0 and b.ordinal = a.ordinal + 1 and b.rn = a.rn))
              join {fx_nodes} d on d.level_id = a.level_id and d.rn = (a.rn + 5) % a.cnt + 1) t on t.order_key = p.k
        join (select 0 as variant union all select 1 as variant union all select 2 as variant) c
             on c.variant = 0 or (c.variant = 1 and p.k % 8 = 0) or (c.variant = 2 and p.k % 404 = 0)""",
    "fx_facilities": f"""
        select l.venue_id, s_suppkey as facility_id, l.level_id, l.ordinal, 2 * (s_suppkey * 13 % 44) + 1 as i, 2 * (s_suppkey * 29 % 36) + 1 as j,
               {lon("(2 * (s_suppkey * 13 % 44) + 1)")} as lon, {lat("(2 * (s_suppkey * 29 % 36) + 1)")} as lat,
               case when s_suppkey % 19 = 0 then 'junk' else l.short_name end as floor,
               case when s_suppkey % 5 = 0 then '  ' || s_name || ' ' when s_suppkey % 7 <> 0 then s_name end as name,
               '/marker/' || lower(s_name) || '.png' as image
        from {{supplier}} join {{fx_levels}} l on l.level_id = 'L' || cast(s_nationkey as varchar(9))""",
    "fx_openings": f"""
        select l.venue_id, 'O' || cast(s_suppkey as varchar(9)) as opening_id, s_suppkey as k, l.level_id, l.ordinal, 8 * (s_suppkey % 9 + 1) as i,
               8 * ((s_suppkey // 9) % 8) + 2 as j0, 8 * ((s_suppkey // 9) % 8) + 6 as j1,
               {lon("(8 * (s_suppkey % 9 + 1))")} as lon, {lat("(8 * ((s_suppkey // 9) % 8) + 4)")} as mid_lat,
               case s_suppkey % 3 when 0 then 'wheelchair' when 1 then '' else 'other' end as accessibility
        from {{supplier}} join {{fx_levels}} l on l.level_id = 'L' || cast(s_nationkey as varchar(9))""",
    "fx_features": """
        select venue_id, 'level' as feature_type, level_id as feature_id, cast(null as varchar(9)) as level_ref, cast(null as varchar(9)) as unit_ref, cast(null as varchar(9)) as anchor_ref,
               cast(null as varchar(40)) as unit_refs, 5 as type_order, cast(pos as bigint) as pos, cast(null as double) as lon, cast(null as double) as lat from {fx_levels}
        union all
        select venue_id, 'unit', unit_id, case when k % 10 <> 3 then level_id end, null, null, null, 6, k, (27953200 + i0 + 4) / 200000.0e0, (7136000 + j0 + 4) / 200000.0e0 from {fx_units}
        union all
        select u.venue_id, 'anchor', 'A' || cast(s.s_suppkey as varchar(9)), null, u.unit_id, null, null, 8, s.s_suppkey, null, null
        from {supplier} s join (select count(*) as parts from {part}) p on true join {fx_units} u on u.k = (s.s_suppkey * 7) % p.parts where s.s_suppkey % 11 <> 0
        union all
        select l.venue_id, 'occupant', 'Q' || cast(s.s_suppkey as varchar(9)), null, null, 'A' || cast(s.s_suppkey as varchar(9)), null, 9, s.s_suppkey, null, null
        from {supplier} s join {fx_levels} l on l.level_id = 'L' || cast(s.s_nationkey as varchar(9))
        union all
        select venue_id, 'amenity', 'M' || cast(k as varchar(9)), case when k % 10 = 0 then level_id end, null, null,
               'U' || cast(k + 1 as varchar(9)) || ',missing' || cast(k as varchar(9)) || ',U' || cast(k as varchar(9)), 10, k, null, null
        from {fx_units} where k % 5 = 0""",
    "fx_relationships": """
        select o.venue_id, 'R' || cast(o.k as varchar(9)) || case when x.extra = 1 then 'b' else '' end as relationship_id, o.opening_id,
               case when x.extra = 1 then b.unit_id else a.unit_id end as origin, case when x.extra = 1 then a.unit_id else b.unit_id end as destination,
               case when o.k % 4 = 0 then 'directed' else 'undirected' end as direction
        from {fx_openings} o
        join {fx_units} a on a.level_id = o.level_id and a.i1 = o.i and a.j0 = o.j0 - 2
        join {fx_units} b on b.level_id = o.level_id and b.i0 = o.i and b.j0 = o.j0 - 2
        join (select 0 as extra union all select 1 as extra) x on x.extra = 0 or o.k % 28 = 0
        where o.k % 2 = 0""",
    "fx_labels": """
        select doc_id as label_id,
               case doc_id % 16 when 0 then 'F' || cast(doc_id % 40 + 1 as varchar(9)) when 1 then 'B2FL(1FL)_x(TP-5.11)' when 2 then '地下' || cast(doc_id % 9 + 1 as varchar(9)) || '階'
                    when 3 then 'KB' || cast(doc_id % 7 + 1 as varchar(9)) when 4 then 'ｆ' || cast(doc_id % 8 + 1 as varchar(9)) when 5 then 'RF' when 6 then 'M' || cast(doc_id % 5 as varchar(9))
                    when 7 then cast(doc_id % 61 as varchar(9)) when 8 then 'b' || cast(doc_id % 12 as varchar(9)) || 'fl' when 9 then 'Level ' || cast(doc_id % 30 as varchar(9))
                    when 10 then '  sb' || cast(doc_id % 6 as varchar(9)) || 'F ' when 11 then '' when 12 then 'GF_hall' when 13 then 'lobby-' || cast(doc_id % 20 as varchar(9)) || 'f'
                    when 14 then cast(doc_id % 25 as varchar(9)) || 'floor east' else source end as label
        from {documents}""",
    "fx_search": """
        select 'V' || cast(p_partkey % 5 as varchar(9)) as venue_id, 'E' || cast(p_partkey as varchar(9)) as entry_id, p_name as label_en, p_brand as label_ja, p_type as alt_label, p_partkey as pos,
               case p_size % 4 when 0 then 'retail' when 1 then 'restaurant' when 2 then 'service' else 'transit' end as category,
               case p_size % 3 when 0 then 'unit' when 1 then 'occupant' else 'amenity' end as feature_type, cast(p_partkey % 5 - 2 as double) as ordinal
        from {part}""",
    "fx_queries": """
        select cast(p_partkey as bigint) as query_id, 'V' || cast(p_partkey % 5 as varchar(9)) as venue_id,
               case p_partkey % 4 when 0 then lower(p_brand) when 1 then upper(substr(p_name, 1, 4)) when 2 then '' else substr(p_type, 2, 5) end as text,
               case p_partkey % 3 when 0 then 'all' when 1 then 'shops' else 'facilities' end as category, cast(p_partkey % 5 - 2 as double) as level_ordinal
        from {part} where p_partkey % 10 = 0""",
    "fx_mutations": """
        select event_id, user_id % 10 as version_id, user_id as author, 'r' || cast(event_id - event_id % 7 * (event_id % 2) as varchar(20)) as request_id, event_type,
               case event_type when 'signup' then 'create_root' when 'click' then 'create_reply' when 'view' then 'patch' when 'purchase' then 'attach' else 'delete' end as op,
               ts, value, SHA[event_type || cast(event_id % 3 as varchar(9))]SHA as request_hash
        from {events}""",
    "fx_triangles": """
        select 'V' || cast(l_suppkey % 5 as varchar(9)) as venue_id, 'm' || cast(l_suppkey % 3 as varchar(9)) as member, 'T' || cast(l_suppkey % 6 as varchar(9)) as level_key, l_orderkey as feature_id, l_linenumber as line_no, t.half,
               case l_orderkey % 6 when 0 then 'Floors' when 1 then 'Walls' when 2 then 'Ceilings' when 3 then 'Floors' when 4 then 'Stairs' else 'Site' end as category,
               8 * (l_partkey % 10) as x0, 8 * l_linenumber as y0, (case l_suppkey % 6 when 5 then 50000 else (l_suppkey % 6 - 2) * 4200 end) + (l_orderkey % 3) * 4 as z_mm
        from {lineitem} join (select 0 as half union all select 1 as half) t on true""",
    "fx_layers": """
        select 'Station' || cast(p_partkey % 5 as varchar(9)) || '_' || t.token || '_' || k.kind as layer_name, p_partkey as pos,
               case (p_size + k.n) % 5 when 0 then 'polygon' when 1 then 'polygon' when 2 then 'line' when 3 then 'point' else 'none' end as family, p_partkey % 7 as feature_count
        from {part} join (select 'B1' as token, 0 as n union all select 'F2', 1 union all select 'M2', 2 union all select 'R', 3 union all select '0', 4) t on t.n = p_partkey % 5
        join (select 'Floor' as kind, 0 as n union all select 'Space', 1 union all select 'Opening', 2 union all select 'Drawing', 3 union all select 'Facility', 4 union all select 'x_to_y_link', 5 union all select 'notes', 6) k on true""",
    "fx_versions": """
        select o_orderkey as version_id, o_custkey % 20 as venue_no, row_number() over (partition by o_custkey % 20 order by o_orderkey) as seq,
               case o_orderstatus when 'F' then 'published' when 'O' then 'draft' else 'failed' end as status,
               case when o_orderkey % 6 <> 0 then SHA[cast(o_orderkey // 3 as varchar(20))]SHA end as bundle_hash, cast(floor(o_totalprice * 10) as bigint) as duration_ms
        from {orders}""",
}

#: In Spark an alternative of two equalities would leave the venue as the join's only key: every path would meet every node of
#: its venue. A level is one ordinal of a venue, so both cases are one key of venue, ordinal and number.
_EITHER = """((a.order_key % 60 <> 0 and b.level_id = a.level_id and b.rn = (a.rn + a.order_key % 3) % a.cnt + 1)
                     or (a.order_key % 60 = 0 and b.ordinal = a.ordinal + 1 and b.rn = a.rn))"""
_KEYED = """b.ordinal = case when a.order_key % 60 = 0 then a.ordinal + 1 else a.ordinal end
                   and b.rn = case when a.order_key % 60 = 0 then a.rn else (a.rn + a.order_key % 3) % a.cnt + 1 end"""

_NAME = re.compile(r"(?<!\{)\{(\w+)\}")


def _dependencies(name: str) -> list[str]:
    return list(dict.fromkeys(_NAME.findall(FIXTURES[name].replace("{{", "{").replace("}}", "}"))))


def _body(name: str) -> str:
    return FIXTURES[name].replace("{{", "{").replace("}}", "}")


def fixture(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A derived table as a lazily planned DataFrame."""
    if name in BASE:
        return spark.read.parquet(f"{folder}/{name}.parquet")
    tables = {d: fixture(spark, folder, d) for d in _dependencies(name)}
    body = _body(name).replace(_EITHER, _KEYED).replace("//", " div ").replace("SHA[", "sha2(").replace("]SHA", ", 256)")
    return spark.sql(body, **tables)


def _ordered(names: tuple[str, ...]) -> list[str]:
    out: list[str] = []

    def visit(name: str) -> None:
        if name in BASE or name in out:
            return
        for d in _dependencies(name):
            visit(d)
        out.append(name)

    for n in names:
        visit(n)
    return out


def oracle(sql: str, *names: str) -> str:
    """``sql`` with the derived tables that it reads as common table expressions before it."""
    found = names or tuple(dict.fromkeys(re.findall(r"\bfx_\w+", sql)))
    parts = [f"{n} as materialized ({_NAME.sub(lambda m: m[1], _body(n)).replace('SHA[', 'sha256(').replace(']SHA', ')')})" for n in _ordered(found)]
    body = sql.strip()
    if body.lower().startswith("with recursive"):
        return "with recursive " + ", ".join([*parts, body[len("with recursive") :].strip()])
    if body.lower().startswith("with "):
        return "with " + ", ".join([*parts, body[5:].strip()])
    return ("with " + ", ".join(parts) + " " if parts else "") + body
