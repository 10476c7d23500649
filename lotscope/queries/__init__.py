"""Registered queries, by family, each with the SQL it must agree with."""

import importlib

FAMILIES = (
    "functions", "market", "history", "rules", "vectors", "decisions", "grading", "marks", "payloads", "streams",
)


def load():
    """(queries, sql) of all families."""
    for family in FAMILIES:
        importlib.import_module(f"lotscope.queries.{family}")
    from lotscope.queries.registry import QUERIES, SQL
    return dict(QUERIES), dict(SQL)
