"""Declared names of a text: kind, name and line."""

from __future__ import annotations

import re

from .comments import mask_comments, mask_literals
from .functions import function_spans
from .languages import language

_N = r"[A-Za-z_]\w*"
#: Per language: expressions over a masked line, with the kind they declare.
_RULES: dict[str, list[tuple[str, str]]] = {
    "script": [(r"^\s*(?:export\s+)*(?:default\s+)?(?:async\s+)?function\s*\*?\s+(?P<name>[A-Za-z_$][\w$]*)", "function"), (r"^\s*(?:export\s+)*const\s+(?P<name>[A-Za-z_$][\w$]*)", "const")],
    "go": [(rf"^\s*func\s*\([^)]*\)\s*(?P<name>{_N})", "method"), (rf"^\s*func\s+(?P<name>{_N})", "function"), *((rf"^\s*{k}\s+(?P<name>{_N})", k) for k in ("type", "const", "var"))],
    "rust": [(rf"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:(?:async|unsafe|const|extern)\s+)*{k}\s+(?:mut\s+)?(?P<name>{_N})", n) for k, n in (("fn", "function"), ("const", "const"), ("static", "static"), ("struct", "struct"), ("enum", "enum"), ("trait", "trait"), ("mod", "mod"), ("type", "type"))],
    "cpp": [(rf"^\s*(?:inline\s+)?namespace\s+(?P<name>{_N})", "namespace"), (rf"^\s*(?:template\s*<[^>]*>\s*)?class\s+(?P<name>{_N})", "class"), (rf"^\s*(?:typedef\s+)?struct\s+(?P<name>{_N})", "struct"), (rf"^\s*enum\s+(?:class\s+|struct\s+)?(?P<name>{_N})", "enum"), (rf"^\s*using\s+(?P<name>{_N})\s*=", "using")],
    "csharp": [(rf"^\s*namespace\s+(?P<name>{_N})", "namespace"), *((rf"^\s*(?:(?:public|private|protected|internal|static|sealed|abstract|partial|readonly)\s+)*{k}\s+(?P<name>{_N})", k) for k in ("class", "struct", "enum", "interface"))],
    "python": [(rf"^\s*async\s+def\s+(?P<name>{_N})", "async-function"), (rf"^\s*def\s+(?P<name>{_N})", "function"), (rf"^\s*class\s+(?P<name>{_N})", "class"), (rf"^\s*(?P<name>{_N})\s*(?::[^=]+)?=(?!=)", "assignment")],
    "shell": [(r"^\s*function\s+(?P<name>[\w-]+)", "function"), (r"^\s*(?P<name>[\w-]+)\s*\(\s*\)", "function"), (rf"^\s*(?:export\s+|readonly\s+|local\s+|declare\s+(?:-\w+\s+)?)?(?P<name>{_N})=", "assignment")],
    "qml": [(rf"^\s*(?:async\s+)?function\s+(?P<name>{_N})", "function"), (rf"^\s*(?:readonly\s+|default\s+|required\s+)*property\s+[\w.<>]+\s+(?P<name>{_N})", "property"), (rf"^\s*signal\s+(?P<name>{_N})", "signal"), (rf"^\s*id\s*:\s*(?P<name>{_N})", "id")],
    "css": [(r"(?:^|[{;\s])(?P<name>--[\w-]+)\s*:", "custom-property"), (r"\.(?P<name>-?[A-Za-z_][\w-]*)(?=[^{};]*\{)", "class")],
    "scss": [(r"(?:^|[{;\s])(?P<name>--[\w-]+)\s*:", "custom-property"), (r"^\s*(?P<name>\$[\w-]+)\s*:", "variable"), (r"^\s*@mixin\s+(?P<name>[\w-]+)", "mixin"), (r"^\s*@function\s+(?P<name>[\w-]+)", "function"), (r"^\s*(?P<name>%[\w-]+)\s*\{", "placeholder"), (r"\.(?P<name>-?[A-Za-z_][\w-]*)(?=[^{};]*\{)", "class")],
}
#: A Go group: names follow, one at the start of each line, up to a line that begins with its end.
_GROUP = re.compile(r"^\s*(?P<kind>const|var|type)\s+\((?P<rest>.*)$")
_GROUPED = re.compile(rf"^\s*(?P<name>{_N})")
_COMPILED = {lang: [(re.compile(p), kind) for p, kind in rules] for lang, rules in _RULES.items()}


def declarations(text: str, ext: str) -> list[dict]:
    lang = language(ext)
    rules = _COMPILED.get(lang)
    if not rules:
        return []
    masked = mask_comments(text, ext) if lang in ("css", "scss") else mask_literals(text, ext)
    out, group = [], ""
    for i, line in enumerate(masked.split("\n"), 1):
        if lang == "go":
            if m := _GROUP.match(line):
                group = "" if ")" in m.group("rest") else m.group("kind")
                continue
            if group and line.lstrip().startswith(")"):
                group = ""
                continue
            if group:
                if m := _GROUPED.match(line):
                    out.append({"kind": group, "name": m.group("name"), "line": i})
                continue
        for pattern, kind in rules:
            every = pattern.finditer(line) if lang in ("css", "scss") else filter(None, [pattern.match(line)])
            hits = [{"kind": kind, "name": m.group("name"), "line": i} for m in every]
            out += hits
            if hits and lang not in ("css", "scss"):
                break
    if lang in ("cpp", "csharp"):
        out += [{"kind": s["kind"], "name": s["name"], "line": s["start_line"]} for s in function_spans(text, ext)]
        out.sort(key=lambda d: d["line"])
    return out


def name_length(name: str) -> int:
    """Code points of a name without the marks ``--``, ``$`` and ``%`` in front."""
    return len(re.sub(r"^(?:--|[$%])", "", name))
