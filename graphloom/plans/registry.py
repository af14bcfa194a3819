"""All named queries of the engine, and the SQL that checks them."""

from __future__ import annotations

from graphloom.operators import alias_automaton, answers, chunks, components, difference, discourse, graph, kb, lexicon, memory, metrics, nodes, provenance, quaternary, ranking, relational, resolve, retrieval, rules, scales, span_align, spatial, stitch, temporal, text, vector_index
from graphloom.sources import bucketed, generators, packed_records, stores, suites
from graphloom.streaming import windows

QUERIES: dict = {}
ORACLE_SQL: dict = {}
for _module in (text, discourse, chunks, span_align, answers, retrieval, vector_index, ranking, quaternary, nodes, kb, components, difference, graph, scales, rules, provenance, lexicon, memory, temporal, metrics, resolve, alias_automaton, stitch, spatial, relational, windows, stores, bucketed, packed_records, generators, suites):
    QUERIES.update(_module.QUERIES)
    ORACLE_SQL.update(_module.ORACLE_SQL)
FLAGSHIP = "bm25_topk"
