"""Model files and services that plugged-in functions need: fetched once, checked, and asked whether they are there."""

from __future__ import annotations

import hashlib
import os
import tempfile
from collections.abc import Callable


def digest(path: str) -> str:
    h = hashlib.sha256()
    with open(path, "rb") as f:
        while part := f.read(1 << 20):
            h.update(part)
    return h.hexdigest()


def provide(name: str, folder: str, sha256: str, fetch: Callable[[str], None]) -> str:
    """The path of a model file in the folder. It is fetched (fetch writes to the path that it is given) unless it is there with that digest; it appears
    under its name only when whole and right, so that others who look meanwhile see none or all of it."""
    path = os.path.join(folder, name)
    if os.path.exists(path) and digest(path) == sha256.lower():
        return path
    os.makedirs(folder, exist_ok=True)
    handle, part = tempfile.mkstemp(prefix=f".{name}.", dir=folder)
    os.close(handle)
    try:
        fetch(part)
        if (got := digest(part)) != sha256.lower():
            raise ValueError(f"{name} has the digest {got} instead of {sha256}")
        os.replace(part, path)
    finally:
        if os.path.exists(part):
            os.remove(part)
    return path


def available(probe: Callable[[], object]) -> bool:
    """Whether a service answers; any failure means no. Asked once, on the driver."""
    try:
        probe()
        return True
    except Exception:
        return False
