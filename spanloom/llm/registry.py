"""All queries of this subpackage by name, and the SQL that checks them."""

from __future__ import annotations

from importlib import import_module

#: Modules with QUERIES (name -> callable of session and directory) and SQL (name -> text).
MODULES = ("split_queries", "neardup_queries", "abuse_queries", "lookalike_queries", "token_queries", "langid_queries")


def llm_queries() -> dict:
    found: dict = {}
    for name in MODULES:
        found |= import_module(f"spanloom.llm.{name}").QUERIES
    return found


def llm_sql() -> dict[str, str]:
    found: dict = {}
    for name in MODULES:
        found |= import_module(f"spanloom.llm.{name}").SQL
    return found
