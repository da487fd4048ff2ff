"""Registered queries: each applies one operator to the given tables, with its SQL twin."""

from importlib import import_module

FAMILIES = ("texts", "addresses", "times", "signals", "leads", "coverage", "stories", "pages", "streams", "collect")


def _load():
    for family in FAMILIES:
        import_module(f"leadflow.plans.{family}")
    return import_module("leadflow.plans.registry")


def all_queries():
    return dict(_load().QUERIES)


def all_sql():
    return dict(_load().SQL)
