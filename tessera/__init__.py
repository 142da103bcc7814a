"""Spark-first analytics over web pages, documents and entity records."""
