"""Registered queries and their SQL counterparts."""

from __future__ import annotations

import importlib

AREAS = ["profiling", "tables", "models", "networks", "imputation"]


def all_queries() -> dict:
    found = {}
    for area in AREAS:
        found.update(importlib.import_module(f"cohortloom.registry.{area}").QUERIES)
    return found


def all_oracles() -> dict[str, str]:
    found = {}
    for area in AREAS:
        found.update(importlib.import_module(f"cohortloom.registry.{area}").ORACLES)
    return found
