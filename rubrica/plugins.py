"""Modules outside of the package that register filters, aggregations or judges' providers when imported."""

from __future__ import annotations

import importlib
import os
from collections.abc import Sequence


def load(names: Sequence[str] | None = None) -> list[str]:
    """Imports the modules, by default those named in RUBRICA_PLUGINS, comma-separated; their decorators register what they bring."""
    wanted = list(names) if names is not None else [n.strip() for n in os.environ.get("RUBRICA_PLUGINS", "").split(",") if n.strip()]
    for name in wanted:
        importlib.import_module(name)
    return wanted
