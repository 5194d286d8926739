"""Registered queries over the driver tables, each beside the SQL that must give the same rows."""

from __future__ import annotations

from quarryline.catalog import corpus, evaluation, sampling, streams, tracking

MODULES = (corpus, sampling, evaluation, tracking, streams)


def queries() -> dict:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for module in MODULES for name, sql in module.ORACLE.items()}
