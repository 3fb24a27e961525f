"""Registered queries."""

from __future__ import annotations

import importlib

_MODULES = ("learning", "loading", "text_documents", "layout_documents", "streams")


def all_queries():
    from paideon.plans.registry import QUERIES

    for name in _MODULES:
        importlib.import_module(f"paideon.plans.{name}")
    return QUERIES
