"""Queries of the core with their SQL, by module."""
from . import build_queries, core_queries, reference_queries, report_queries, source_queries, verify_queries


def modules() -> list:
    return [reference_queries, verify_queries, source_queries, build_queries, report_queries, core_queries]
