"""Registered queries over the driver tables, each with its SQL twin where SQL can express it."""

import importlib

from vistrata.catalog.base import QUERIES, SQL

for _name in ("columns", "aggregates", "charts", "models", "questions", "files"):
    importlib.import_module(f"vistrata.catalog.{_name}")

__all__ = ["QUERIES", "SQL"]
