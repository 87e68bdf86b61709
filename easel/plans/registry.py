"""All registered queries of the curation operators and their SQL."""

from __future__ import annotations

from importlib import import_module

_MODULES = ("geometry_queries", "collect_queries", "image_queries", "score_queries", "tag_queries", "pixel_queries")


def _all(what: str) -> dict:
    out: dict = {}
    for m in _MODULES:
        out |= getattr(import_module(f"easel.plans.{m}"), what)
    return out


def queries() -> dict:
    return _all("QUERIES")


def oracles() -> dict[str, str]:
    return _all("ORACLE")
