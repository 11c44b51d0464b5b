"""Small JSON files of a project: reading with comments, writing in a stable form."""

from __future__ import annotations

import json
import os
import re
import time
from pathlib import Path

_NOISE = re.compile(r'"(?:[^"\\]|\\.)*"|//[^\n]*|/\*.*?\*/', re.S)


def parse_jsonc(text: str):
    """JSON that may hold comments and trailing commas."""
    bare = _NOISE.sub(lambda m: m.group() if m.group()[0] == '"' else " ", text)
    tidy = re.sub(r'("(?:[^"\\]|\\.)*")|,(?=\s*[}\]])', lambda m: m.group(1) or "", bare)
    return json.loads(tidy)


def read_manifest(path: str | Path, tries: int = 20, wait: float = 0.05):
    """The parsed file, or None where there is none; a half-written file is tried again."""
    for k in range(tries):
        try:
            return parse_jsonc(Path(path).read_text())
        except FileNotFoundError:
            return None
        except json.JSONDecodeError:
            if k + 1 == tries:
                raise
            time.sleep(wait)
    return None


def stable(value) -> str:
    return json.dumps(value, indent=2, sort_keys=True, ensure_ascii=False)


def same(a, b) -> bool:
    return stable(a) == stable(b)


def write_manifest(path: str | Path, value) -> bool:
    """Write in stable form if it differs; whether it did."""
    if (old := read_manifest(path)) is not None and same(old, value):
        return False
    p = Path(path)
    p.parent.mkdir(parents=True, exist_ok=True)
    p.write_text(stable(value) + "\n")
    return True


def _natural(name: str) -> list:
    return [int(x) if x.isdigit() else x for x in re.split(r"(\d+)", name)]


def read_alias_folder(folder: str) -> dict[str, str]:
    """All JSON maps of a folder in numeric-aware order; the first definition of an id wins."""
    out: dict[str, str] = {}
    names = sorted((n for n in os.listdir(folder) if n.endswith(".json")), key=_natural) if os.path.isdir(folder) else []
    for n in names:
        for k, v in (read_manifest(os.path.join(folder, n)) or {}).items():
            out.setdefault(k, v)
    return out


def write_alias_folder(folder: str, aliases: dict[str, str], per_file: int = 1000) -> int:
    """The map in files of per_file ids, sorted; surplus files go.  The number of files written."""
    ids, written = sorted(aliases), 0
    chunks = [ids[i : i + per_file] for i in range(0, len(ids), per_file)]
    for k, chunk in enumerate(chunks, 1):
        written += write_manifest(os.path.join(folder, f"aliases-{k}.json"), {i: aliases[i] for i in chunk})
    for n in os.listdir(folder) if os.path.isdir(folder) else []:
        m = re.fullmatch(r"aliases-(\d+)\.json", n)
        if m and int(m.group(1)) > len(chunks):
            os.remove(os.path.join(folder, n))
    return written


def managed_imports(package: dict, prefix: str = "#") -> dict[str, str]:
    """Import ids of a package manifest with the prefix and a relative target."""
    return {k: v for k, v in (package.get("imports") or {}).items() if k.startswith(prefix) and isinstance(v, str) and v.startswith(".")}


def with_managed_imports(package: dict, aliases: dict[str, str], prefix: str = "#") -> dict:
    """The manifest with the managed ids replaced and all others kept."""
    kept = {k: v for k, v in (package.get("imports") or {}).items() if k not in managed_imports(package, prefix)}
    dotted = {k: v if v.startswith(".") else "./" + v for k, v in aliases.items()}
    return {**package, "imports": {**kept, **dotted}}


def with_paths(tsconfig: dict, aliases: dict[str, str], source_prefix: str = "") -> dict:
    """The config with the aliases as paths, others kept, and no baseUrl."""
    options = {k: v for k, v in (tsconfig.get("compilerOptions") or {}).items() if k != "baseUrl"}
    kept = {k: v for k, v in (options.get("paths") or {}).items() if k not in aliases and not any(t.removeprefix("./").startswith(source_prefix) and source_prefix for t in v)}
    options["paths"] = {**kept, **{k: [v if v.startswith(".") else "./" + v] for k, v in aliases.items()}}
    return {**tsconfig, "compilerOptions": options}


def with_include(tsconfig: dict, roots: list[str]) -> dict:
    include = list(tsconfig.get("include") or [])
    return {**tsconfig, "include": include + [g for r in roots if (g := f"{r}/**/*.ts") not in include]}


def add_ignore_entry(root: str, entry: str) -> bool:
    """Append an entry to the ignore file once."""
    p = Path(root, ".gitignore")
    old = p.read_text() if p.exists() else ""
    if entry in old.splitlines():
        return False
    p.write_text(old + ("" if not old or old.endswith("\n") else "\n") + entry + "\n")
    return True
