"""Graphs of code and change, and corpus preparation, as Spark DataFrame jobs."""
