"""Tidemark: a Spark-first analytics engine for metric series, records, tables and search."""
