"""A folder of files that tasks have written, made known by one small manifest.

Readers see the files that the manifest lists and no others.  It is replaced
in one step, so a failed or repeated task leaves files that nobody reads, and
an overwrite that fails leaves what was there.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable

NAME = "manifest.json"


def read(folder: str) -> dict:
    """{layer: {..., "parts": [{"file": name, ...}]}}; empty where there is no manifest."""
    try:
        with open(os.path.join(folder, NAME), encoding="utf-8") as f:
            return json.load(f)["layers"]
    except FileNotFoundError:
        return {}


def fresh(folder: str, layer: str, ending: str) -> str:
    """A file name that no other task or attempt takes."""
    os.makedirs(folder, exist_ok=True)
    safe = "".join(c if c.isalnum() else "_" for c in layer)
    return f"{safe}-{uuid.uuid4().hex}{ending}"


def replace(folder: str, change: Callable[[dict], dict]) -> None:
    """Put ``change`` of the layers in place of them, then remove the files that only the old ones name."""
    os.makedirs(folder, exist_ok=True)
    old = read(folder)
    new = change({k: dict(v, parts=list(v["parts"])) for k, v in old.items()})
    staged = os.path.join(folder, f".{uuid.uuid4().hex}.json")
    with open(staged, "w", encoding="utf-8") as f:
        json.dump({"layers": new}, f)
        f.flush()
        os.fsync(f.fileno())
    os.replace(staged, os.path.join(folder, NAME))
    files = lambda layers: {p["file"] for v in layers.values() for p in v["parts"]}
    discard(folder, files(old) - files(new))


def discard(folder: str, names) -> None:
    for name in names:
        try:
            os.remove(os.path.join(folder, name))
        except FileNotFoundError:
            pass


def meets(part: dict, box: tuple | None) -> bool:
    """Whether a part may hold rows that meet a box."""
    own = part.get("box")
    return box is None or own is not None and own[0] <= box[2] and own[2] >= box[0] and own[1] <= box[3] and own[3] >= box[1]


def joined(boxes) -> tuple[float, float, float, float] | None:
    """The box of all boxes."""
    some = [b for b in boxes if b]
    return (min(b[0] for b in some), min(b[1] for b in some), max(b[2] for b in some), max(b[3] for b in some)) if some else None
