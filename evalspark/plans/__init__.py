"""Registered queries over the provided tables, with their SQL counterparts."""

from __future__ import annotations


def all_queries():
    """Import every query module once and return the registry."""
    from evalspark.plans import join_queries, metric_queries, model_queries, report_queries, rule_queries, source_queries, split_feature_queries  # noqa: F401
    from evalspark.plans.registry import QUERIES

    return QUERIES
