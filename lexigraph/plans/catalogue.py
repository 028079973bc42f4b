"""The registered queries and the SQL that states the same, gathered from their modules."""

from . import event_queries, extract_queries, graph_queries, lexical_queries, store_queries, stream_queries, text_queries, version_queries

MODULES = (lexical_queries, graph_queries, event_queries, text_queries, version_queries, extract_queries, stream_queries, store_queries)
QUERIES: dict = {name: query for module in MODULES for name, (query, _) in module.REGISTERED.items()}
ORACLES: dict = {name: sql for module in MODULES for name, (_, sql) in module.REGISTERED.items() if sql}
