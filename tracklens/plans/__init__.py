"""Query plans over the driver tables, one module per lane."""

from __future__ import annotations

import importlib

MODULES = ["causal", "response", "joins", "audit", "splits", "metrics", "sequence", "grid", "corpus", "sources", "models", "transfer", "linear", "bands", "scoring", "streaming"]


def load_all():
    from . import registry

    for m in MODULES:
        importlib.import_module(f"{__name__}.{m}")
    return registry.QUERIES, registry.ORACLES
