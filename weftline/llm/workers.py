"""What Python workers share: they are reused, so a task gives back the memory that it freed."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import cache


@cache
def _trim() -> Callable[[int], int] | None:
    try:
        return ctypes.CDLL("libc.so.6").malloc_trim
    except (OSError, AttributeError):
        return None


def trim() -> None:
    """Returns freed memory to the system, where the C library can."""
    if f := _trim():
        f(0)


def trimmed(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` for mapInArrow, with ``trim`` after each batch."""

    def wrapped(batches: Iterator) -> Iterator:
        for out in run(batches):
            yield out
            del out
            trim()

    return wrapped
