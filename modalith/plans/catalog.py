"""Imports every module that registers queries."""

from modalith.plans import metric_queries, observation_queries, report_queries, store_queries, text_queries, vector_queries  # noqa: F401
