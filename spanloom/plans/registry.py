"""All queries of the core by name, and the SQL that checks them."""

from __future__ import annotations

from importlib import import_module

#: Modules with QUERIES (name -> callable of session and directory) and SQL (name -> text).
MODULES = ("training_core", "interval_queries", "candidate_queries", "text_queries", "queue_queries", "measure_queries")


def core_queries() -> dict:
    found: dict = {}
    for name in MODULES:
        found |= import_module(f"spanloom.plans.{name}").QUERIES
    return found


def core_sql() -> dict[str, str]:
    found: dict = {}
    for name in (*MODULES, "fold_sql"):
        found |= import_module(f"spanloom.plans.{name}").SQL
    return found
