"""Objects that a Python worker builds once and keeps between tasks (decoders, tokenizers, compiled grammars)."""

from __future__ import annotations

import sys
from collections.abc import Callable
from typing import Any


def resource(key: Any, make: Callable[[], Any]) -> Any:
    """The object of this process under ``key``, made on first use; never pickled with a plan."""
    kept = sys.__dict__.setdefault("_seamark_resources", {})
    if key not in kept:
        kept[key] = make()
    return kept[key]
