"""All queries over the given tables, by name, and their SQL."""

from __future__ import annotations

from panelwright.plans import decisions, evaluation, modelling, panel, profiles, quality, storage
from panelwright.sources.tables import Tables

MODULES = [quality, profiles, panel, evaluation, decisions, storage, modelling]


def _over_tables(query):
    return lambda spark, sf_dir: query(Tables(spark, sf_dir))


def queries():
    return {name: _over_tables(q) for m in MODULES for name, q in m.QUERIES.items()}


def oracle_sql():
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
