"""Queries of the engine's operators over the driver's tables, each with its DuckDB SQL where SQL can express it.

``QUERIES`` maps a name to a function of (spark, sf_dir); ``SQL`` maps it to the SQL.
"""

from __future__ import annotations

import importlib

from plumbline.queries.registry import QUERIES, SQL

for _name in ("scores", "shapes", "groups", "pairs", "components", "clusters", "learning", "serving", "reads"):
    importlib.import_module(f"plumbline.queries.{_name}")

__all__ = ["QUERIES", "SQL"]
