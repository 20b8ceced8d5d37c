"""Writers of landing files for readers that must never see half a file."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterable, Iterator
from pathlib import Path


def write_atomic(folder: str | Path, name: str, text: str) -> Path:
    """Write beside the target under a hidden name, then rename."""
    folder = Path(folder)
    folder.mkdir(parents=True, exist_ok=True)
    hidden = folder / f".{name}.{uuid.uuid4().hex}.tmp"
    hidden.write_text(text)
    os.replace(hidden, folder / name)
    return folder / name


def snapshot(folder: str | Path, document: dict, *, required: tuple[str, ...], name: str | None = None) -> Path:
    """Land one validated JSON document; keys of ``required`` may be dotted."""
    for key in required:
        at: object = document
        for part in key.split("."):
            if not isinstance(at, dict) or part not in at:
                raise ValueError(f"the document lacks {key}")
            at = at[part]
    return write_atomic(folder, name or f"{uuid.uuid4().hex}.json", json.dumps(document))


def batches(events: Iterable[dict], *, max_bytes: int, max_events: int) -> Iterator[list[str]]:
    """Lines in batches of bounded size; an event that is too large by itself raises."""
    held: list[str] = []
    size = 0
    for e in events:
        line = json.dumps(e)
        n = len(line.encode()) + 1
        if n > max_bytes:
            raise ValueError(f"an event has {n} bytes; a batch may have {max_bytes}")
        if held and (size + n > max_bytes or len(held) >= max_events):
            yield held
            held, size = [], 0
        held.append(line)
        size += n
    if held:
        yield held


def replay(folder: str | Path, events: Iterable[dict], *, key: str, max_bytes: int = 1_000_000, max_events: int = 500) -> int:
    """Land events as message files for :func:`readers.messages_from_files`; their number."""
    messages = ({"key": str(e.get(key)), "value": json.dumps(e), "partition": 0, "offset": i} for i, e in enumerate(events))
    total = 0
    for i, lines in enumerate(batches(messages, max_bytes=max_bytes, max_events=max_events)):
        write_atomic(folder, f"batch-{i:06d}.json", "\n".join(lines) + "\n")
        total += len(lines)
    return total
