"""What a Python worker keeps between tasks: tokenizers with the words they remember.

Spark gives a worker to one task after another, also of other jobs. Tasks that need their memory for
something else let go of what earlier ones left behind. What a task has freed goes back to the system,
since a worker may idle beside others that need the memory.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Hashable

import pyarrow as pa

_KEPT: dict[Hashable, object] = {}
_C = ctypes.CDLL(None)


def kept(key: Hashable, make: Callable[[], object]):
    """The object of this worker for ``key``, made when it is asked for first."""
    if key not in _KEPT:
        _KEPT[key] = make()
    return _KEPT[key]


def released() -> None:
    """Forget everything that is kept, and give its memory back."""
    if _KEPT:
        _KEPT.clear()
        gc.collect()  # encoders hold references to themselves
    trimmed()


def trimmed() -> None:
    """Hand memory that was freed back to the system, which C and Arrow allocators would keep for later."""
    pa.default_memory_pool().release_unused()
    if hasattr(_C, "malloc_trim"):
        _C.malloc_trim(0)
