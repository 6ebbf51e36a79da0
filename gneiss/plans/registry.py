"""All queries of the core with their oracle SQL."""

from gneiss.plans import data_jobs, evaluation_queries, graph_queries, record_queries, resolution_queries, search_queries

_MODULES = [data_jobs, graph_queries, search_queries, resolution_queries, record_queries, evaluation_queries]

QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLE = {k: s for m in _MODULES for k, s in m.ORACLE.items()}
