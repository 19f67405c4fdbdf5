"""Spark-native engine for graph-shaped facts: lookups, joins, overlays, evidence ranking, data flow and defect queries."""
