"""Named queries over the driver tables, each with a SQL twin where SQL can say it."""

from plansift.catalog.registry import ORACLE, QUERIES, load_all

__all__ = ["QUERIES", "ORACLE", "load_all"]
