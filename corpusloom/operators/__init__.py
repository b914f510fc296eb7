"""Table operators: dedup, contamination, audits, knowledge graph, evaluation, packing."""
