"""Tessera: a SQL dialect and query operators that compile to Spark."""
