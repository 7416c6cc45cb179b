"""Operators for building training corpora, as Spark jobs."""
