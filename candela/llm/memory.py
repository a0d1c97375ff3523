"""Who of the operators holds memory in a Python worker. Workers outlive tasks and serve other operators next."""

from __future__ import annotations

import ctypes
import threading
from collections.abc import Callable

#: Seconds without a task after which a worker's memory is given back.
IDLE = 5.0
_TIMER: list[threading.Timer] = []
_RELEASE: dict[str, Callable[[], None]] = {}
_OWNER: list[str] = []


def claim(name: str, release: Callable[[], None]) -> None:
    """From now on the worker is `name`'s: what others remember is released, and what it remembers itself stays for now."""
    while _TIMER:
        _TIMER.pop().cancel()
    _RELEASE[name] = release
    if _OWNER != [name]:
        _OWNER[:] = [name]
        for other, free in _RELEASE.items():
            if other != name:
                free()


def rest(name: str) -> None:
    """At a task's end: if no other claims the worker soon, what `name` remembers goes, as an idle worker's memory counts beside the next stage's."""

    def free() -> None:
        _RELEASE[name]()
        trim()

    timer = threading.Timer(IDLE, free)
    timer.daemon = True
    _TIMER.append(timer)
    timer.start()


def trim() -> None:
    """Give freed memory back to the system, as an idle worker's memory counts beside the next stage's."""
    import pyarrow

    pyarrow.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass
