"""All queries of the package: name -> (callable, SQL counterpart)."""

from leakscope.plans import creative_queries, delivery_queries, source_queries


def registered() -> dict:
    return delivery_queries.QUERIES | creative_queries.QUERIES | source_queries.QUERIES
