"""State that a Python worker keeps from task to task."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Hashable

_NAME = "_corpusmatch_worker"


def once_per_worker(key: Hashable, make: Callable[[], object], keep: int = 4):
    """What ``make`` gave for this key when this process first asked; the last ``keep`` keys are remembered.

    The package's functions travel with each task, so their module's globals are new each time; a module of
    the process itself is not.
    """
    held = sys.modules.setdefault(_NAME, types.ModuleType(_NAME)).__dict__.setdefault("held", {})
    if key not in held:
        while len(held) >= keep:
            held.pop(next(iter(held)))
        held[key] = make()
    return held[key]
