"""All queries of the library with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from gleanery.plans.queries import ORACLES, QUERIES
from gleanery.session import prepare

ROOT = str(Path(__file__).resolve().parents[2])


def _prepared(f: Callable) -> Callable:
    def run(spark, sf_dir):
        prepare(spark, ROOT)
        return f(spark, sf_dir)

    run.__name__ = f.__name__
    return run


def queries() -> dict[str, Callable]:
    return {name: _prepared(f) for name, f in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
