"""Spark-native relational and data-quality operators with PostgreSQL's semantics."""
