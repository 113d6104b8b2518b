"""Registered queries over the given tables."""

# Importing a module registers its queries.
from hirelake.plans import company_queries, inventory_queries, job_queries, search_queries, text_queries  # noqa: F401
from hirelake.plans.registry import ORACLES, QUERIES


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLES)
