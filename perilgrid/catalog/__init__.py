"""The queries this library registers, by name."""

from __future__ import annotations

from importlib import import_module

from perilgrid.catalog.registry import CHECKS, QUERIES

_SECTIONS = ("intake", "scoring", "alerting", "places", "reading")


def _load() -> None:
    for section in _SECTIONS:
        import_module(f"perilgrid.catalog.{section}")


def all_queries():
    _load()
    return dict(QUERIES)


def all_checks() -> dict[str, str]:
    _load()
    return dict(CHECKS)
