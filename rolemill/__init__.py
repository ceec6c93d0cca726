"""Labelling experiments on annotated token data, as Spark jobs."""
