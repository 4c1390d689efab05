"""Lodestar: retrieval, governance and corpus analytics as Spark jobs."""
