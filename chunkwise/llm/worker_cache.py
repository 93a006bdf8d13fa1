"""Values that a Python worker builds once and keeps for its later tasks.

Functions of this package travel to the workers by value, so a worker without
an installed copy can run them; what such a function keeps in its own module's
globals ends with the task.  These values sit in a module made in the worker
itself.  At most ``KEPT`` are held, the oldest go first; of the large ones a worker
holds only the one used last, as workers go from one job to the next.
"""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Hashable

HOLDER = "_chunkwise_worker_values"
KEPT = 16


def per_worker(key: Hashable, build: Callable, large: bool = False):
    """``build()``, once per process and key."""
    if HOLDER not in sys.modules:
        sys.modules[HOLDER] = types.ModuleType(HOLDER)
        sys.modules[HOLDER].values, sys.modules[HOLDER].large = {}, None
    holder = sys.modules[HOLDER]
    values = holder.values
    if large and holder.large != key:
        values.pop(holder.large, None)
        holder.large = key
    if key not in values:
        made = build()
        while len(values) >= KEPT:
            del values[next(iter(values))]
        values[key] = made
    return values[key]
