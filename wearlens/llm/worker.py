"""What a Python worker process keeps from task to task."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable
from typing import Any


def kept(name: str, make: Callable[[], Any]) -> Any:
    """The process's object of this name, made at its first use.

    The package travels by value (see wearlens/__init__.py), so a module's own dictionary is a new one in every task; a module
    that the interpreter knows by name lives as long as the process.
    """
    store = sys.modules.setdefault("_kept_by_worker", types.ModuleType("_kept_by_worker")).__dict__
    if name not in store:
        store[name] = make()
    return store[name]
