"""Query registry of the venue operators."""

from __future__ import annotations

from atrium.plans import gate_queries, import_queries, model_queries, network_queries, record_queries, route_queries, scene_queries, spatial_queries, stream_queries, venue_queries, view_queries

MODULES = (gate_queries, network_queries, venue_queries, import_queries, spatial_queries, route_queries, scene_queries, record_queries, model_queries, stream_queries, view_queries)

QUERIES: dict = {}
ORACLES: dict = {}
for _module in MODULES:
    QUERIES.update(_module.QUERIES)
    ORACLES.update(_module.ORACLES)
