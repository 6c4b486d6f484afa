"""Execution-verified curation of text-to-SQL data as Spark jobs."""
