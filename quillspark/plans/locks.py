"""Mutual exclusion of writers by files that only one can create."""

from __future__ import annotations

import contextlib
import json
import os
import time
from collections.abc import Iterator

STALE_SECONDS = 900


def _stale(path: str) -> bool:
    try:
        held = json.loads(open(path, encoding="utf-8").read())
        os.kill(int(held["pid"]), 0)
    except ProcessLookupError:
        return True
    except PermissionError:
        return False
    except (OSError, ValueError, KeyError, TypeError):
        return True
    return time.time() - float(held.get("ts", 0)) > STALE_SECONDS


@contextlib.contextmanager
def lock(path: str) -> Iterator[None]:
    """Hold a lock file; one left by a dead process or too old is taken over once. Raises FileExistsError if held."""
    for attempt in (0, 1):
        try:
            handle = os.open(path, os.O_CREAT | os.O_EXCL | os.O_WRONLY)
            break
        except FileExistsError:
            if attempt or not _stale(path):
                raise
            with contextlib.suppress(FileNotFoundError):
                os.remove(path)
    with os.fdopen(handle, "w") as f:
        json.dump({"pid": os.getpid(), "ts": time.time()}, f)
    try:
        yield
    finally:
        with contextlib.suppress(FileNotFoundError):
            os.remove(path)
