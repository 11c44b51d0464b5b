"""The public calls: check and fix a tree, check any table, sync aliases."""

from __future__ import annotations

import logging
import math
import os
import random
import sys
import time
from collections.abc import Callable
from contextlib import contextmanager
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

from . import config as cfg
from .functions import paths
from .operators.imports import alias_ids
from .plans import check as plans
from .plans import fix as fixes
from .sources import manifests, tree


@dataclass
class Result:
    ok: bool
    violation_count: int
    violations: list[dict]
    rules: list[str] = field(default_factory=list)
    counters: dict = field(default_factory=dict)


def format_duration(milliseconds: float) -> str:
    """Seconds from a second on, whole milliseconds from 100, tenths below."""
    if milliseconds >= 1000:
        return f"{milliseconds / 1000:.{1 if milliseconds >= 10_000 else 2}f}s"
    return f"{math.floor(milliseconds + 0.5)}ms" if milliseconds >= 100 else f"{milliseconds:.1f}ms"


def format_bytes(n: int) -> str:
    for unit, size in (("MiB", 1 << 20), ("KiB", 1 << 10)):
        if n >= size:
            return f"{n / size:.1f}{unit}"
    return f"{n}B"


LEVELS = ("debug", "info", "warn", "error")


class EventLog:
    """An on_event that passes events on from a level up, and counts them by level.

    The adapter is "console", a logger of the logging module, or a function of
    (level, message, facts); without one events are only counted.
    """

    _LEVEL = {"scan": "debug", "rule": "info", "checked": "info", "fixed": "info", "blocked": "error"}

    def __init__(self, adapter: str | logging.Logger | Callable[[str, str, dict], None] | None = None, level: str = "info"):
        self.adapter, self.least, self.counts = adapter, LEVELS.index(level), dict.fromkeys(LEVELS, 0)

    def __call__(self, kind: str, facts: dict) -> None:
        level = self._LEVEL.get(kind, "info")
        if kind == "rule" and facts.get("blocking"):
            level = "warn"
        self.counts[level] += 1
        if LEVELS.index(level) < self.least or self.adapter is None:
            return
        message = f"{kind} " + " ".join(f"{k}={format_duration(v) if k == 'elapsed_ms' else v}" for k, v in facts.items())
        if self.adapter == "console":
            print(f"[{level}] {message}", file=sys.stderr)
        elif isinstance(self.adapter, logging.Logger):
            getattr(self.adapter, "warning" if level == "warn" else level)(message)
        else:
            self.adapter(level, message, facts)


class Runner:
    """Runs with hooks: before_run, before_mode, after_mode, after_run, and on_event for progress (see EventLog)."""

    def __init__(self, spark: SparkSession, root: str, config: dict, *, presets: dict | None = None, on_event: Callable[[str, dict], None] | None = None):
        if not os.path.isdir(root):
            raise cfg.ConfigError("root-invalid", f"{root} is not a folder")
        self.spark, self.root, self.on_event = spark, os.path.abspath(root), on_event or (lambda kind, facts: None)
        self.raw = cfg.resolve(config, presets)

    def _hook(self, name: str, state: dict) -> None:
        if (f := (self.raw.get("lifecycle") or {}).get(name)) is not None:
            f(state)

    def _read(self, config: dict) -> tuple[DataFrame, DataFrame]:
        ignore = tree.ignore_patterns(self.root) if config["use_gitignore"] else []
        return tree.read_tree(self.spark, self.root, extensions=config["extensions"], exclude=config["exclude"], ignore=ignore)

    def _aliases(self, config: dict, files: DataFrame) -> DataFrame | None:
        options = config["rules"].get("imports", {}).get("alias") or {}
        return alias_ids(files.select("path"), options["strategy"], options.get("prefix", "#")) if options.get("strategy") in ("relative-path-slug", "relative-path-hash") else None

    def violations(self, only: list[str] | None = None) -> DataFrame:
        """The plan of check, for trees whose violations are too many for the driver; no hook is called."""
        config = cfg.normalize(self.raw, only=only)
        files, dirs = self._read(config)
        return plans.check(config, plans.lexed(files, config["selected"]), dirs, self._aliases(config, files), already_lexed=True)

    def check(self, only: list[str] | None = None) -> Result:
        state = {"mode": "check", "root": self.root}
        self._hook("before_run", state)
        config = cfg.normalize(self.raw, only=only)
        self._hook("before_mode", state)
        self.on_event("scan", {"root": self.root})
        began = time.monotonic()
        files, dirs = self._read(config)
        shared = plans.lexed(files, config["selected"]).cache()
        try:
            found = plans.check(config, shared, dirs, self._aliases(config, files), already_lexed=True)
            rows = [row.asDict() for row in plans.ordered(found).collect()]
        finally:
            shared.unpersist()
        blocking = [v for v in rows if v["severity"] != "warning"]
        result = Result(not blocking, len(rows), rows, sorted({v["rule"] for v in rows}))
        for rule in result.rules:
            own = [v for v in rows if v["rule"] == rule]
            self.on_event("rule", {"rule": rule, "violations": len(own), "blocking": sum(v["severity"] != "warning" for v in own)})
        self.on_event("checked", {"violations": len(rows), "elapsed_ms": 1000 * (time.monotonic() - began)})
        if blocking:
            self.on_event("blocked", {"violations": len(blocking)})
        self._hook("after_mode", state)
        self._hook("after_run", state)
        return result

    def fix(self, only: list[str] | None = None) -> Result:
        state = {"mode": "fix", "root": self.root}
        self._hook("before_run", state)
        config = cfg.normalize(self.raw, only=only, mode="fix")
        self._hook("before_mode", state)
        files, _ = self._read(config)
        aliases = self._aliases(config, files)
        aliases = None if aliases is None else self.spark.createDataFrame(aliases.collect(), "id string, path string")
        began = time.monotonic()
        counters = fixes.fix(self.spark, self.root, config, aliases)
        self.on_event("fixed", {**counters, "elapsed_ms": 1000 * (time.monotonic() - began)})
        left = Runner(self.spark, self.root, self.raw).check_selected(config["selected"])
        self._hook("after_mode", state)
        self._hook("after_run", state)
        return Result(left.ok, left.violation_count, left.violations, left.rules, counters)

    def check_selected(self, rules: list[str]) -> Result:
        raw, self.raw = self.raw, {**self.raw, "lifecycle": {}}
        try:
            return self.check(rules)
        finally:
            self.raw = raw


def random_alias(prefix: str, taken: set[str], length: int = 12, seed: int | None = None) -> str:
    """A free id of base-36 characters; an error after 64 tries."""
    rng = random.Random(seed)
    for _ in range(64):
        name = prefix + "".join(rng.choice("0123456789abcdefghijklmnopqrstuvwxyz") for _ in range(length))
        if name not in taken:
            return name
    raise cfg.ConfigError("alias-exhausted", "no free alias id was found")


def sync_aliases(root: str, inventory: list[str], *, strategy: str | Callable[[str, set[str], str], str] = "random", prefix: str = "#", existing: dict[str, str] | None = None, length: int = 12, seed: int | None = None) -> dict[str, str]:
    """id -> path for every file: valid ids that exist are kept, new ones allocated in path order."""
    import hashlib
    import re

    files, by_path = set(inventory), {}
    for name in sorted(existing or {}):
        target = paths.clean(existing[name])
        if target in files and target not in by_path and re.match(r"^[^\s\"'`\x00./][^\s\"'`\x00]*$", name):
            by_path[target] = name
    taken = set(by_path.values())
    for k, path in enumerate(sorted(files - set(by_path))):
        if callable(strategy):
            name = strategy(path, set(taken), prefix)
            if name in taken or not re.match(r"^[^\s\"'`\x00./][^\s\"'`\x00]*$", name):
                raise cfg.ConfigError("alias-invalid", f"{name!r} is taken or not a valid alias id")
        elif strategy == "random":
            name = random_alias(prefix, taken, length, None if seed is None else seed + k)
        else:
            stem = os.path.splitext(path)[0]
            base = prefix + (hashlib.sha1(path.encode()).hexdigest()[:12] if strategy == "relative-path-hash" else re.sub("^-+|-+$", "", re.sub("[^a-z0-9]+", "-", stem.lower())) or "module")
            name, n = base, 2
            while name in taken:
                name, n = f"{base}-{n}", n + 1
        by_path[path] = name
        taken.add(name)
    return {name: path for path, name in by_path.items()}


def manifest_drift(root: str, aliases: dict[str, str], tsconfig: str = "tsconfig.json") -> list[str]:
    """Manifests that do not say what the aliases would have them say."""
    out = []
    current = manifests.read_manifest(os.path.join(root, tsconfig))
    if current is not None and not manifests.same(current, manifests.with_paths(current, aliases)):
        out.append(tsconfig)
    package = manifests.read_manifest(os.path.join(root, "package.json"))
    if package is not None and not manifests.same(package, manifests.with_managed_imports(package, aliases)):
        out.append("package.json")
    return out


def imports(spark: SparkSession, root: str, *, fix: bool = False, strategy: str | Callable = "relative-path-slug", prefix: str = "#", output: str = "tsconfig", allow_relative: list[str] | Callable[[str, dict], bool] | None = None, seed: int | None = None) -> Result:
    """Bring aliases, manifests and imports of a tree in line, or say what is not.

    output: ``tsconfig`` writes the aliases as paths, ``folder`` as files of a
    map under .fathomline/imports.  A package manifest mirrors them.
    """
    from .lex.languages import IMPORT_EXTENSIONS
    from .operators import imports as rules

    files, _ = tree.read_tree(spark, root, ignore=tree.ignore_patterns(root))
    inventory = [row[0] for row in files.filter(files.ext.isin(IMPORT_EXTENSIONS)).select("path").orderBy("path").collect()]
    folder, tsconfig = os.path.join(root, ".fathomline", "imports"), os.path.join(root, "tsconfig.json")
    current = manifests.read_manifest(tsconfig)
    paths_now = {k: v[0] for k, v in ((current or {}).get("compilerOptions", {}).get("paths") or {}).items() if v}
    existing = manifests.read_alias_folder(folder) if output == "folder" else paths_now
    aliases = sync_aliases(root, inventory, strategy=strategy, prefix=prefix, existing=existing, seed=seed)
    table = spark.createDataFrame(sorted(aliases.items()), "id string, path string")
    covered = {g.split("/")[0] for g in (current or {}).get("include") or []}
    if not fix:
        found = [row.asDict() for row in rules.imports(files, table, allow_relative=allow_relative).orderBy("file_path", "message").collect()]
        blank = {"fix": True, "details": "{}", "suggested_path": None, "severity": None, "rule": "imports"}
        drift = [] if output == "folder" and manifests.read_alias_folder(folder) == aliases else manifest_drift(root, aliases)
        found += [{**blank, "file_path": name, "message": f"{name} does not match the aliases"} for name in drift]
        if current is not None and current.get("include"):
            found += [{**blank, "file_path": "tsconfig.json", "message": f"include does not cover {r[0]}"} for r in rules.uncovered_roots(table, sorted(covered)).orderBy("root").collect()]
        return Result(not found, len(found), found, ["imports"] if found else [])
    n = {"manifests": 0}
    if output == "folder":
        n["manifests"] += manifests.write_alias_folder(folder, aliases)
        manifests.add_ignore_entry(root, ".fathomline/reports/")
    elif current is not None:
        new = manifests.with_paths(current, aliases)
        if current.get("include"):
            new = manifests.with_include(new, [r[0] for r in rules.uncovered_roots(table, sorted(covered)).orderBy("root").collect()])
        n["manifests"] += manifests.write_manifest(tsconfig, new)
    package = manifests.read_manifest(os.path.join(root, "package.json"))
    if package is not None:
        n["manifests"] += manifests.write_manifest(os.path.join(root, "package.json"), manifests.with_managed_imports(package, aliases, prefix))
    edits = fixes.alias_edits(files, table, allow_relative).unionByName(fixes.removal_edits(files))
    from .sources.sinks import commit

    n |= commit(root, {row["path"]: row["new_text"] for row in fixes.specifier_rewrites(files, edits).collect()})
    return Result(True, 0, [], [], {"imports": n})


@contextmanager
def tsconfig_paths(root: str, name: str = "tsconfig.json", restore: bool = True):
    """While the block runs, path targets of the config start with a dot; then it is as before."""
    path = os.path.join(root, name)
    before = open(path).read() if os.path.exists(path) else None
    value = manifests.read_manifest(path)
    if value is not None:
        manifests.write_manifest(path, manifests.with_paths(value, {k: v[0] for k, v in (value.get("compilerOptions", {}).get("paths") or {}).items() if v}))
    try:
        yield
    finally:
        if restore and before is not None:
            with open(path, "w") as f:
                f.write(before)


def format_targets(files: DataFrame, targets: list[str] | None = None, ignore: dict | None = None) -> DataFrame:
    """Files to format: under one of the targets and outside what is ignored, each once.

    ignore: names, name_globs, paths, prefixes and globs.
    """
    from pyspark.sql import functions as F

    skip = ignore or {}
    name = paths.basename(F.col("path"))
    out = F.lit(False)
    if skip.get("names"):
        out = out | name.isin(skip["names"])
    if skip.get("paths"):
        out = out | F.col("path").isin(skip["paths"])
    for g in skip.get("name_globs", []):
        out = out | paths.glob_matches(name, g)
    for g in skip.get("globs", []):
        out = out | paths.glob_matches(F.col("path"), g)
    for p in skip.get("prefixes", []):
        out = out | F.startswith("path", F.lit(p))
    inside = F.lit(not targets)
    for t in targets or []:
        t = paths.clean(t).rstrip("/")
        inside = inside | (F.col("path") == t) | F.startswith("path", F.lit(t + "/"))
    return files.filter(inside & ~out).dropDuplicates(["path_abs"]).orderBy("path")


def render(result: Result, warnings: bool = True) -> str:
    """A line per violation and one in sum; warnings may be left out of sight."""
    shown = [v for v in result.violations if warnings or v["severity"] != "warning"]
    lines = [f"{'warn' if v['severity'] == 'warning' else 'fail'}  {v['rule']}  {v['file_path']}  {v['message']}" for v in shown]
    n = result.violation_count
    return "\n".join([*lines, "ok" if result.ok and not n else f"{n} violation{'s' if n != 1 else ''}"])


def save_report(folder: str, result: Result, now: datetime | None = None) -> str:
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, (now or datetime.now()).strftime("report-%Y-%m-%d-%H-%M-%S.txt"))
    with open(path, "w") as f:
        f.write(render(result) + "\n")
    return path
