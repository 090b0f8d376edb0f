"""Tremor: change-impact analytics over code-graph tables, written as Spark DataFrame jobs."""
