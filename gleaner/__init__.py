"""Gleaner: a Spark-first engine for auditing asset trees and cleaning training corpora.

The audit's public names are loaded when first asked for, so that executors load no more than their tasks use.
"""

from __future__ import annotations

import importlib

__version__ = "0.1.0"

_PUBLIC = {
    "gleaner.config": ("AuditConfig", "ConfigError", "load_config"),
    "gleaner.plans.audit": ("Audit", "Runner"),
    "gleaner.plans.checks": ("Check", "Context", "REGISTRY", "finding"),
    "gleaner.plans.resolve": ("Resolution", "resolve"),
    "gleaner.sources.project": ("Project", "load"),
    "gleaner.sources.images": ("decode_png", "difference_hash", "fingerprint"),
    "gleaner.report": ("as_json", "as_markdown", "as_text"),
    "gleaner.delete": ("Outcome",),
    "gleaner.cli": ("main",),
}
_HOME = {name: module for module, names in _PUBLIC.items() for name in names}
__all__ = sorted(_HOME)


def __getattr__(name: str):
    if name in _HOME:
        return getattr(importlib.import_module(_HOME[name]), name)
    raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
