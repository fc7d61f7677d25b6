"""Registered queries of the search engine."""

from .catalogue import ORACLES, QUERIES, flagship


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLES)


__all__ = ["flagship", "oracle_sql", "queries"]
