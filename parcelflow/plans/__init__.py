"""Compositions of operators: batch pipelines, registered queries and their SQL twins."""
