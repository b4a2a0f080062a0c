"""Structural analytics over source code and its history, as Spark jobs."""
