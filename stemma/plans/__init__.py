"""Named queries over the stored tables."""

from __future__ import annotations

import importlib

_MODULES = ["vector", "text", "files", "bridge", "citation", "network", "catalog", "validation", "json", "layout", "stream", "document", "record", "index", "html"]


def _registries():
    for m in _MODULES:
        try:
            yield importlib.import_module(f"stemma.plans.{m}_plans").R
        except ModuleNotFoundError as e:
            if not str(e.name).startswith("stemma.plans."):
                raise


def all_queries() -> dict:
    out = {}
    for r in _registries():
        out.update(r.queries)
    return out


def all_oracles() -> dict:
    out = {}
    for r in _registries():
        out.update(r.oracles)
    return out
