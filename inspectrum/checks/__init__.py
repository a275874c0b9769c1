"""Registered queries over the driver tables and the SQL they are compared with."""

from __future__ import annotations

import importlib

MODULES = ["reports", "rows", "learning"]


def load() -> None:
    """Import every module that registers queries."""
    for name in MODULES:
        importlib.import_module(f"inspectrum.checks.{name}")
