"""Hypergraph, ranking and evidence analytics as composable Spark DataFrame operators."""
