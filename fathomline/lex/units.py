"""Structural units: what should stand apart by exactly one blank line.

A unit is a function, type or block of a scope.  In scripts, units are the
statements of the top level, and the members of classes and namespaces.
Comments and attributes right above a unit belong to it.
"""

from __future__ import annotations

import re

from .comments import mask_comments, mask_literals
from .functions import _SHELL, _header, _width
from .languages import language

_TYPE = {
    "rust": re.compile(r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:unsafe\s+)?(?:struct|enum|trait|impl|mod|union|extern)\b"),
    "cpp": re.compile(r"^\s*(?:template\s*<.*>\s*)?(?:class|struct|enum|namespace|union)\b[^;]*$"),
    "csharp": re.compile(r"^\s*(?:(?:public|private|protected|internal|static|sealed|abstract|partial|readonly)\s+)*(?:class|struct|enum|interface|namespace|record)\b"),
    "go": re.compile(r"^\s*type\s+\w+\s+(?:struct|interface)\b"),
    "css": re.compile(r"^[^{}]*\{"), "scss": re.compile(r"^[^{};$]*\{"),
    "qml": re.compile(r"^\s*(?:(?:async\s+)?function\b|[A-Z]\w*(?:\.\w+)*\s*\{)"),
}
_ATTACHED = {"rust": ("#[", "#!["), "csharp": ("[",), "python": ("@",), "cpp": ("template",)}
_SCRIPT_GROUPS = [
    ("import", r"import\b"), ("export-from", r"export\s+(?:\*|\{)"), ("interface", r"(?:export\s+)?(?:declare\s+)?interface\b"), ("type", r"(?:export\s+)?(?:declare\s+)?type\s+\w"),
    ("class", r"(?:export\s+)?(?:default\s+)?(?:declare\s+)?(?:abstract\s+)?class\b"), ("enum", r"(?:export\s+)?(?:declare\s+)?(?:const\s+)?enum\b"), ("namespace", r"(?:export\s+)?(?:declare\s+)?(?:namespace|module)\b"),
    ("function", r"(?:export\s+)?(?:default\s+)?(?:declare\s+)?(?:async\s+)?function\b"), ("variable", r"(?:export\s+)?(?:declare\s+)?(?:const|let|var)\b"), ("return", r"return\b"), ("block", r"(?:if|for|while|do|switch|try)\b"), ("export", r"export\b"),
]
_SCRIPT = [(g, re.compile(p)) for g, p in _SCRIPT_GROUPS]
_MEMBER = re.compile(r"(?:(?:public|private|protected|static|readonly|abstract|override|async|declare|get|set)\s+|\*)*(?P<name>#?[A-Za-z_$][\w$]*|\[[^\]]*\])\s*(?:<[^<>]*>)?\s*(?P<call>\()?")
#: Groups whose neighbours may stand together or apart by one line.
COMPACT = frozenset(("import", "export-from", "variable", "type", "expression", "property", "export"))


def structural_units(text: str, ext: str) -> list[dict]:
    lang = language(ext)
    if not lang:
        return []
    masked = mask_literals(text, ext).split("\n")
    commented = mask_comments(text, ext).split("\n")
    raw = text.split("\n")
    if lang == "script":
        found = _script(masked, raw, commented)
    elif lang == "python":
        found = _indented(masked, raw)
    else:
        found = _braced(masked, lang)
    out = []
    for scope, group, name, start, end in sorted(found, key=lambda u: (u[0], u[3])):
        out.append({"scope": scope, "group": group, "name": name, "start_line": _above(start, lang, raw, commented), "end_line": end})
    return out


def _above(start: int, lang: str, raw: list[str], commented: list[str]) -> int:
    """The first line (from 1) of the comments and attributes that stand right above a line."""
    k = start - 1
    while k > 0:
        line = raw[k - 1].strip()
        comment = line and not commented[k - 1].strip()
        if not line or not (comment or line.startswith(_ATTACHED.get(lang, ("\0",)))) or k == 1 and line.startswith("#!"):
            break
        k -= 1
    return k + 1


def _close(lines: list[str], at: int) -> int | None:
    """The line that closes the braces opened from ``at`` on; None if none opens before a semicolon."""
    depth, begun, paren = 0, False, 0
    for j in range(at, len(lines)):
        for c in lines[j]:
            if c == "{":
                begun, depth = True, depth + 1
            elif c == "}":
                depth -= 1
            elif c in "([":
                paren += 1
            elif c in ")]":
                paren -= 1
            elif c == ";" and not begun and paren <= 0:
                return None
            if begun and depth <= 0:
                return j
    return None


def _braced(lines: list[str], lang: str, first: int = 0, last: int | None = None, scope: str = "0") -> list[tuple]:
    out, i = [], first
    last = len(lines) if last is None else last
    kind = _TYPE.get(lang)
    while i < last:
        line = lines[i]
        is_type = bool(kind and kind.match(line))
        is_function = lang == "shell" and _SHELL.match(line) or lang not in ("css", "scss", "qml", "shell") and _header(line, lang)
        if not line.strip() or not (is_type or is_function):
            i += 1
            continue
        end = _close(lines, i)
        if end is None or end >= last:
            i += 1
            continue
        out.append((scope, None, None, i + 1, end + 1))
        if is_type and not is_function:
            inner = next((k for k in range(i, end + 1) if "{" in lines[k]), i)
            if lang not in ("css", "scss"):
                out += _braced(lines, lang, inner + 1, end, f"{scope}.{i + 1}")
        i = end + 1
    return out


def _indented(lines: list[str], raw: list[str]) -> list[tuple]:
    out, open_ = [], []
    pattern = re.compile(r"^(?P<indent>[ \t]*)(?:(?:async[ \t]+)?def|class)\b")
    last_full = 0
    n = len(lines)
    for i, line in enumerate([*lines, "end"]):
        s = line.strip()
        if i < n and not s:
            if raw[i].strip() and not raw[i].strip().startswith("#"):
                last_full = i + 1
            continue
        width = _width(line[: len(line) - len(line.lstrip())])
        while open_ and width <= open_[-1][0] and not (s[:1] in ")]}"):
            _, scope, start = open_.pop()
            out.append((scope, None, None, start, last_full))
        if i < n and pattern.match(line):
            scope = f"{open_[-1][1]}.{open_[-1][2]}" if open_ else "0"
            open_.append((width, scope, i + 1))
        last_full = i + 1
    return out


def _statements(lines: list[str], first: int, last: int) -> list[tuple[int, int]]:
    """Line ranges of statements between two lines: they begin at depth 0."""
    out, depth, start = [], 0, None
    for i in range(first, last):
        line = lines[i]
        if start is None:
            if not line.strip():
                continue
            start = i
        depth += sum(line.count(c) for c in "([{") - sum(line.count(c) for c in ")]}")
        s = line.strip()
        following = next((lines[k].strip() for k in range(i + 1, last) if lines[k].strip()), "")
        goes_on = s.endswith(("=", "=>", "+", "-", "*", "&&", "||", "??", "?", ":", ",", "(", ".")) or following.startswith((".", "?", "&&", "||", "+ ", "else", "catch", "finally", "{"))
        if depth <= 0 and not goes_on:
            out.append((start, i))
            depth, start = 0, None
    if start is not None:
        out.append((start, last - 1))
    return out


def _script(lines: list[str], raw: list[str], commented: list[str]) -> list[tuple]:
    out = []

    def top(first: int, last: int, scope: str) -> None:
        for a, b in _statements(lines, first, last):
            s = commented[a].strip()
            if a == 0 and s.startswith("#!"):
                continue
            group = next((g for g, p in _SCRIPT if p.match(s)), "expression")
            name = re.match(r"(?:export\s+)?(?:default\s+)?(?:declare\s+)?(?:async\s+)?function\s*\*?\s*([\w$]+)", s)
            out.append((scope, group, name.group(1) if name else None, a + 1, b + 1))
            inner = next((k for k in range(a, b + 1) if "{" in lines[k]), None)
            if inner is not None and b > inner:
                if group == "class":
                    members(inner + 1, b, f"{scope}.{a + 1}")
                elif group == "namespace":
                    top(inner + 1, b, f"{scope}.{a + 1}")

    def members(first: int, last: int, scope: str) -> None:
        for a, b in _statements(lines, first, last):
            m = _MEMBER.match(commented[a].strip())
            method = bool(m and m.group("call"))
            out.append((scope, "method" if method else "property", m.group("name") if m and method else None, a + 1, b + 1))

    top(0, len(lines), "0")
    return out


def boundary_edits(text: str, ext: str) -> list[dict]:
    """Splices of whole lines that bring every gap to what it should be.

    at_line is the line (from 1) before which blank lines change.
    """
    raw, by, out = text.split("\n"), {}, []
    for u in structural_units(text, ext):
        by.setdefault(u["scope"], []).append(u)
    for units in by.values():
        for one, two in zip(units, units[1:], strict=False):
            between = raw[one["end_line"] : two["start_line"] - 1]
            gap = two["start_line"] - one["end_line"] - 1
            if gap < 0 or any(x.strip() for x in between):
                continue
            compact = one["group"] is not None and (one["group"] == two["group"] and one["group"] in COMPACT or one["name"] is not None and one["name"] == two["name"])
            if gap == 1 or compact and gap == 0:
                continue
            out.append({"at_line": two["start_line"], "remove_count": max(gap - 1, 0) if gap else 0, "insert_count": 1 if not gap else 0})
    return sorted(out, key=lambda e: e["at_line"])


def apply_edits(text: str, edits: list[dict]) -> str:
    """The text after the splices, with the line ends it has."""
    nl = "\r\n" if "\r\n" in text else "\n"
    lines = text.replace("\r\n", "\n").split("\n")
    for e in sorted(edits, key=lambda e: -e["at_line"]):
        at = e["at_line"] - 1
        lines[at - e["remove_count"] : at] = []
        at -= e["remove_count"]
        lines[at:at] = [""] * e["insert_count"]
    return nl.join(lines)
