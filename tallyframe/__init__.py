"""Spark operators for curating, scoring and summarising tables of model generations."""
