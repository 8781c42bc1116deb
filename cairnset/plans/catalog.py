"""All queries outside the training-data subpackage, by name."""

from __future__ import annotations

from cairnset.plans import detail_queries, error_queries, evaluation_queries, learned_queries, selection_queries, similarity_queries, space_queries

FLAGSHIP = "nn_win_summary"
_MODULES = (error_queries, similarity_queries, selection_queries, space_queries, evaluation_queries, learned_queries, detail_queries)
QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
SQL = {name: text for m in _MODULES for name, text in m.SQL.items()}
