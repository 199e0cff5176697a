"""Memory of Python workers, which live on from task to task."""

from __future__ import annotations

import ctypes

import pyarrow as pa


def release() -> None:
    """Give free memory back to the system, so that a worker doesn't hold the peak of each stage it has seen."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library: it keeps its free memory
        pass
