"""Registered queries: each reads whole tables and, where SQL can restate it, has an oracle."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}

SECTIONS = ["ingest", "outlines", "store", "identifiers", "lookups", "searches", "scans",
            "taxonomies", "graphs", "quality", "edits", "mints", "publications", "streams"]


def query(name: str, oracle: str | None = None):
    def add(fn: Callable) -> Callable:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return add


def load_all() -> None:
    for section in SECTIONS:
        import_module(f"catalog.{section}")
