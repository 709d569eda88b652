"""All registered queries of the library (those of the llm subpackage aside) and their SQL."""

from __future__ import annotations

from marlstone.plans import aggregate_queries, classifier_queries, community_queries, decision_queries, gate_queries, graph_queries, merge_queries, scalar_queries, selection_queries, signal_queries, slice_queries, source_queries, trial_queries

GROUPS = [scalar_queries.group, gate_queries.group, merge_queries.group, aggregate_queries.group, classifier_queries.group, decision_queries.group, source_queries.group, slice_queries.group, graph_queries.group, selection_queries.group, signal_queries.group, community_queries.group, trial_queries.group]

QUERIES = {name: fn for g in GROUPS for name, fn in g.queries.items()}
SQL = {name: sql for g in GROUPS for name, sql in g.sql.items()}
