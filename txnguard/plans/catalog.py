"""Every registered query with its check SQL (None where plain SQL cannot express it)."""

from __future__ import annotations

import importlib

MODULES = ["pattern_queries", "decode_queries", "monitor_queries", "ml_queries", "boost_queries", "stream_queries", "live_queries", "source_queries"]


def catalog() -> dict:
    out = {}
    for name in MODULES:
        found = importlib.import_module(f"txnguard.plans.{name}").QUERIES
        clash = out.keys() & found.keys()
        if clash:
            raise ValueError(f"registered twice: {sorted(clash)}")
        out.update(found)
    return out
