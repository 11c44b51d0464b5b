"""Committing a plan: rewrites, deletions, moves and folders, from the driver.

The plan is checked as a whole before the first write.
"""

from __future__ import annotations

import os
from pathlib import Path


class PlanConflict(ValueError):
    """A plan that cannot be carried out as it stands."""


def check_moves(root: str, moves: list[tuple[str, str]]) -> None:
    sources, targets = {a for a, _ in moves}, [b for _, b in moves]
    if twice := sorted({t for t in targets if targets.count(t) > 1}):
        raise PlanConflict(f"several files would move to {twice[0]}")
    for t in targets:
        if os.path.exists(os.path.join(root, t)) and t not in sources:
            raise PlanConflict(f"{t} exists already")


def commit(root: str, rewrites: dict[str, str] | None = None, deletes: list[str] | None = None, moves: list[tuple[str, str]] | None = None) -> dict[str, int]:
    """Apply rewrites, then deletions, then moves; empty folders left by moves go."""
    moves = list(moves or [])
    check_moves(root, moves)
    n = {"rewritten": 0, "deleted": 0, "moved": 0}
    for path, text in (rewrites or {}).items():
        Path(root, path).write_bytes(text.encode())
        n["rewritten"] += 1
    for path in dict.fromkeys(deletes or []):
        p = Path(root, path)
        if p.exists():
            p.unlink()
            n["deleted"] += 1
    parked = []
    for k, (a, b) in enumerate(moves):  # a target may be another's source
        park = f"{a}.moving-{k}"
        os.rename(os.path.join(root, a), os.path.join(root, park))
        parked.append((park, b))
    for park, b in parked:
        os.makedirs(os.path.dirname(os.path.join(root, b)), exist_ok=True)
        os.rename(os.path.join(root, park), os.path.join(root, b))
        n["moved"] += 1
    for folder in sorted({os.path.dirname(a) for a, _ in moves}, key=len, reverse=True):
        _drop_if_empty(root, folder)
    return n


def _drop_if_empty(root: str, folder: str) -> None:
    while folder:
        try:
            os.rmdir(os.path.join(root, folder))
        except OSError:
            return
        folder = os.path.dirname(folder)


def remove_empty_folders(root: str, keep) -> int:
    """Remove empty folders, deepest first, until none is left; keep(path) guards some."""
    gone = 0
    while True:
        found = []
        for at, dirs, files in os.walk(root):
            rel = os.path.relpath(at, root).replace(os.sep, "/")
            dirs[:] = [d for d in dirs if not keep(d if rel == "." else f"{rel}/{d}")]
            if rel != "." and not os.listdir(at):
                found.append(rel)
        if not found:
            return gone
        for rel in sorted(found, key=lambda p: (-p.count("/"), p)):
            os.rmdir(os.path.join(root, rel))
            gone += 1
