"""All registries of the core library."""

from __future__ import annotations

from quarrykit.plans import Registry


def registries() -> list[Registry]:
    from quarrykit.plans import corpus_queries, graph_queries, nested_queries, rule_queries, search_queries, stream_queries, timeline_queries

    return [m.registry for m in (nested_queries, corpus_queries, search_queries, rule_queries, timeline_queries, graph_queries, stream_queries)]
