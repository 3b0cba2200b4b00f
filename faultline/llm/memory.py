"""Handing freed memory back between large pieces of work."""

from __future__ import annotations

import ctypes

import pyarrow as pa


def release() -> None:
    """Arrow's pool and the C allocator keep what was freed; a worker that goes on to the next large row does without."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it, others need not
    if trim is not None:
        trim(0)
