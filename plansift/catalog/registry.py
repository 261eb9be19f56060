"""Registry that pairs a Spark query with its SQL twin."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from plansift.catalog.oracle_views import VIEWS

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}

FAMILIES = [
    "cleaning", "openings", "gates", "datasets", "masks", "components",
    "matching", "drawing", "crawl", "store", "training", "streams", "flows",
]


def sql(views: str, body: str) -> str:
    """Prefix ``body`` with the named view definitions.

    ``body`` starts with SELECT, or with further ``name AS (...)`` definitions.
    """
    names: list[str] = []
    for view in views.split():
        for name in VIEWS[view][0].split() + [view]:
            if name not in names:
                names.append(name)
    parts = ", ".join(f"{name} AS ({VIEWS[name][1]})" for name in names)
    body = body.strip()
    if not parts:
        return body if body.upper().startswith(("SELECT", "WITH")) else f"WITH {body}"
    joiner = " " if body.upper().startswith("SELECT") else ", "
    recursive = "RECURSIVE " if "USING KEY" in body or "RECURSIVE_CTE" in body else ""
    return f"WITH {recursive}{parts}{joiner}{body}"


def query(name: str, views: str = "", oracle: str | None = None):
    def wrap(fn: Callable) -> Callable:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = sql(views, oracle)
        return fn

    return wrap


def rnd(expr: str, digits: int) -> str:
    """SQL text of ``functions.numeric.round_to``."""
    return f"(floor(({expr}) * 1e{digits} + 0.5000001::DOUBLE) / 1e{digits})"


def load_all() -> None:
    for family in FAMILIES:
        importlib.import_module(f"plansift.catalog.{family}")
