"""Configs: loading, merging presets, and checking before anything is planned."""

from __future__ import annotations

import importlib.util
import json
import math
from pathlib import Path

from .functions.paths import clean
from .lex.languages import DEFAULT_EXTENSIONS
from .schema import FIXABLE, RULES

#: Where a config is looked for.
CONFIG_NAMES = ("fathomline.config.json", "fathomline.config.py")


class ConfigError(ValueError):
    """A config that cannot be used; ``code`` names the reason."""

    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code


#: rule -> option -> default; ... marks a required option.
OPTIONS: dict[str, dict] = {
    "banned-patterns": {"patterns": ...}, "banned-files": {"patterns": ...}, "min-file-lines": {"min": 1}, "min-declaration-name": {"min": 2},
    "max-declaration-name": {"max": 50}, "max-file-lines": {"max": ...}, "max-characters-per-line": {"max": 150}, "max-function-lines": {"max": ...},
    "redundant-path-segments": {"separators": ["_", "-"]}, "remove-empty-folders": {},
    "imports": {"allow_relative": ["./"], "remove_dead_imports": False, "alias": {}, "output": {}, "runtime": {}},
    "remove-comments": {"exclude": []}, "structural-blank-lines": {}, "dry": {"min_duplicate_characters": 0}, "format": {},
}
#: Rules that refuse options they do not know.
STRICT = ("remove-empty-folders", "structural-blank-lines", "remove-comments", "format")
_COMMON = ("severity", "exclude_dirs")

# fixed values: what only a process boundary may touch
ENV_PATTERNS = ("process.env", 'process["env"]', "process['env']")
PROCESS_PATTERNS = ("process.argv", "process.cwd(", "process.exit(", "process.pid", "process.platform", "process.arch", "process.memoryUsage(", "process.stdin", "process.stdout", "process.stderr", "process.on(")


def find_config(root: str) -> Path | None:
    return next((p for n in CONFIG_NAMES if (p := Path(root, n)).exists()), None)


def load_config(root: str, path: str | None = None) -> dict:
    """A JSON file, or a Python file that defines ``config``."""
    p = Path(path) if path else find_config(root)
    if p is None or not p.exists():
        raise ConfigError("config-missing", f"no config found in {root}")
    if p.suffix == ".py":
        spec = importlib.util.spec_from_file_location("fathomline_config", p)
        module = importlib.util.module_from_spec(spec)
        spec.loader.exec_module(module)
        value = getattr(module, "config", None)
    else:
        from .sources.manifests import parse_jsonc

        value = parse_jsonc(p.read_text())
    if not isinstance(value, dict):
        raise ConfigError("config-invalid", "a config must be an object")
    return value


def check_version(config: dict, version: str) -> None:
    """for_version must come first and agree in major and minor."""
    if "for_version" not in config:
        return
    if next(iter(config)) != "for_version":
        raise ConfigError("version-misplaced", "for_version must be the first key")
    if str(config["for_version"]).split(".")[:2] != version.split(".")[:2]:
        raise ConfigError("version-mismatch", f"the config is for {config['for_version']}, this is {version}")


def _pattern_entry(p) -> dict:
    return {"value": p, "allowed_files": []} if isinstance(p, str) else {"value": p["value"], "allowed_files": list(p.get("allowed_files") or [])}


def merge(low: dict, high: dict, path: tuple = ()) -> dict:
    """high over low: records recurse, lists are joined without repeats, scalars override.

    Banned patterns of equal small letters become one with both allow-lists.
    """
    out = dict(low)
    for k, v in high.items():
        old = out.get(k)
        if path[-1:] == ("banned-patterns",) and k == "patterns" and old is not None:
            joined: dict[str, dict] = {}
            for p in map(_pattern_entry, [*old, *v]):
                e = joined.setdefault(p["value"].strip().lower(), {"value": p["value"], "allowed_files": []})
                e["allowed_files"] += [a for a in p["allowed_files"] if a not in e["allowed_files"]]
            out[k] = list(joined.values())
        elif isinstance(old, dict) and isinstance(v, dict):
            out[k] = merge(old, v, (*path, k))
        elif isinstance(old, list) and isinstance(v, list):
            seen = {json.dumps(x, sort_keys=True) for x in old}
            out[k] = old + [x for x in v if json.dumps(x, sort_keys=True) not in seen]
        else:
            out[k] = v
    return out


def resolve(config: dict, presets: dict[str, dict] | None = None) -> dict:
    """Named presets from left to right, then helpers, then the config itself."""
    base: dict = {}
    for name in config.get("presets") or []:
        if name not in (presets or {}):
            raise ConfigError("preset-unknown", f"unknown preset {name}")
        if "presets" in presets[name]:
            raise ConfigError("preset-nested", f"preset {name} names presets itself")
        base = merge(base, presets[name])
    boundary = (config.get("helpers") or {}).get("process_boundary")
    if boundary:
        allowed = boundary if isinstance(boundary, dict) else {}
        groups = ((ENV_PATTERNS, "env_files"), (PROCESS_PATTERNS, "process_files"))
        patterns = [{"value": v, "allowed_files": list(allowed.get(key) or [])} for values, key in groups for v in values]
        base = merge(base, {"rules": {"banned-patterns": {"patterns": patterns}}})
    return merge(base, {k: v for k, v in config.items() if k not in ("presets", "helpers")})


def _threshold(rule: str, key: str, value):
    if isinstance(value, bool) or not isinstance(value, (int, float)) or not math.isfinite(value):
        raise ConfigError("threshold-invalid", f"{rule}.{key} must be a number")
    return max(1, math.floor(value))


def exclusions(value, where: str) -> list[dict]:
    out = []
    for e in value or []:
        if not isinstance(e, dict) or e.get("type", "folder") not in ("file", "folder") or not str(e.get("pattern") or "").strip():
            raise ConfigError("exclusion-invalid", f"{where}: an entry needs a type (file or folder) and a pattern")
        entry = {"type": e.get("type", "folder"), "pattern": clean(e["pattern"].strip()).rstrip("/")}
        if entry not in out:
            out.append(entry)
    return out


def normalize_rule(rule: str, given) -> dict:
    if rule not in OPTIONS:
        raise ConfigError("rule-unknown", f"unknown rule {rule}")
    given = {} if given is True or given is None else dict(given)
    known = OPTIONS[rule]
    if rule in STRICT and (odd := set(given) - set(known) - set(_COMMON)):
        raise ConfigError("option-unknown", f"{rule} has no option {sorted(odd)[0]}")
    severity = given.get("severity", "fail")
    if severity not in ("fail", "warning"):
        raise ConfigError("severity-invalid", f"{rule}: severity is fail or warning")
    out = {"severity": severity, "exclude_dirs": exclusions(given.get("exclude_dirs"), rule)}
    for key, default in known.items():
        if default is ... and given.get(key) is None:
            raise ConfigError("option-required", f"{rule} needs {key}")
        value = given.get(key, default)
        if key in ("min", "max"):
            value = _threshold(rule, key, value)
        elif key == "min_duplicate_characters":
            if isinstance(value, bool) or not isinstance(value, (int, float)) or not math.isfinite(value):
                raise ConfigError("threshold-invalid", f"{rule}.{key} must be a number")
            value = max(0, math.floor(value))
        out[key] = value
    if rule == "banned-patterns":
        out["patterns"] = [e for e in map(_pattern_entry, out["patterns"]) if e["value"].strip()]
        out["patterns"] = [{**e, "value": e["value"].strip()} for e in out["patterns"]]
    if rule == "banned-files":
        out["patterns"] = [p.strip() for p in out["patterns"] if p.strip()]
    if rule in ("banned-patterns", "banned-files") and not out["patterns"]:
        raise ConfigError("option-required", f"{rule} needs at least one pattern")
    return out


def select_rules(configured: list[str], only: list[str] | None, mode: str) -> list[str]:
    """The rules of a run in their fixed order; selectors must be known, configured and fit the mode."""
    order = FIXABLE if mode == "fix" else RULES
    if not only:
        return [r for r in order if r in configured]
    for r in only:
        if r not in RULES:
            raise ConfigError("selector-unknown", f"unknown rule {r}")
        if r not in configured:
            raise ConfigError("selector-unconfigured", f"{r} is not configured")
        if mode == "fix" and r not in FIXABLE:
            raise ConfigError("selector-not-fixable", f"{r} cannot be fixed")
    return [r for r in order if r in only]


def normalize(config: dict, *, only: list[str] | None = None, mode: str = "check") -> dict:
    """A checked config: rules with all options, extensions and exclusions."""
    rules = {r: normalize_rule(r, o) for r, o in (config.get("rules") or {}).items() if o is not False}
    ignore = config.get("ignore") or {}
    if not isinstance(ignore, dict) or not isinstance(ignore.get("use_gitignore", True), bool):
        raise ConfigError("ignore-invalid", "ignore must be an object with use_gitignore as a boolean")
    dropped = {e.lower() for e in config.get("exclude_extensions") or []}
    width = rules.get("max-characters-per-line", {}).get("max", 100)
    return {
        "rules": rules, "selected": select_rules(list(rules), only, mode), "exclude": exclusions(ignore.get("entries"), "ignore"), "use_gitignore": ignore.get("use_gitignore", True),
        "extensions": [e for e in DEFAULT_EXTENSIONS if e not in dropped], "width": width, "logging": config.get("logging") or {}, "lifecycle": config.get("lifecycle") or {},
    }
