"""All queries of the core, by name, with their SQL counterparts."""

from __future__ import annotations

from arcloom.plans import cluster_queries, graph_queries, java_queries, model_queries, reference_integrity, text_queries, view_queries

MODULES = [reference_integrity, graph_queries, model_queries, text_queries, cluster_queries, java_queries, view_queries]
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLE = {name: sql for m in MODULES for name, sql in m.ORACLE.items()}
FLAGSHIP = "feature_graph_nodes"
