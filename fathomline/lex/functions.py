"""Function spans of a text: kind, name, lines, and how many of them hold code."""

from __future__ import annotations

import re

from .comments import mask_comments, mask_literals
from .languages import language

#: Words that begin a statement or a type, never a C-family function.
_NOT_FUNCTIONS = frozenset(
    "if else for foreach while do switch case catch return throw using namespace class struct enum union interface record typedef "
    "new delete sizeof lock fixed get set goto default".split()
)
_NAME_BEFORE_PAREN = re.compile(r"([~A-Za-z_$][\w$]*|operator\s*\S+?)\s*(?:<[^<>()]*>)?\s*\(")
_RUST = re.compile(r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:default\s+)?(?:(?:async|unsafe|const)\s+)*(?:extern\s+(?:\"[^\"]*\"\s*|\s*))?fn\s+(?P<name>[A-Za-z_]\w*)")
_GO = re.compile(r"^\s*func\s*(?P<receiver>\([^)]*\)\s*)?(?P<name>[A-Za-z_]\w*)\s*[\[(]")
_SCRIPT_NAME = re.compile(r"\bfunction\s*\*?\s*([A-Za-z_$][\w$]*)|(?:^|\s)(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*(?::[^=]+)?=")
_SHELL = re.compile(r"^\s*(?:function\s+(?P<a>[\w.:-]+)\s*(?:\(\s*\))?|(?P<b>[\w.:-]+)\s*\(\s*\))\s*\{")
_QML = (
    (re.compile(r"^\s*(?:async\s+)?function\s+([A-Za-z_$][\w$]*)\s*\("), "function"),
    (re.compile(r"^\s*(?:property\s+\w+\s+)?([A-Za-z_$][\w$]*)\s*:\s*(?:async\s+)?function\b"), "function"),
    (re.compile(r"^\s*(?:[A-Za-z_][\w]*\.)?(on[A-Z]\w*)\s*:\s*(?:(?:function\s*)?\([^)]*\)\s*(?:=>\s*)?)?\{"), "signal-handler"),
)
_PYTHON = re.compile(r"^[ \t]*(?P<late>async[ \t]+)?def[ \t]+(?P<name>[A-Za-z_]\w*)")


def function_spans(text: str, ext: str) -> list[dict]:
    lang = language(ext)
    finder = {"script": _script, "go": _block, "rust": _block, "cpp": _block, "csharp": _block, "python": _python, "shell": _shell, "qml": _qml}.get(lang)
    if finder is None:
        return []
    lines = mask_literals(text, ext).split("\n")
    found = finder(lines, lang, text.split("\n"))
    code = [0]
    for line in mask_comments(text, ext).split("\n"):
        code.append(code[-1] + bool(line.strip()))
    last = len(code) - 1
    return [
        {"kind": kind, "name": name, "start_line": a, "end_line": b, "line_count": b - a + 1, "code_line_count": code[min(b, last)] - code[min(a - 1, last)]}
        for kind, name, a, b in found
    ]


def _header(line: str, lang: str) -> tuple[str, str] | None:
    """(kind, name) if a function may begin on this line."""
    if lang == "rust":
        return ("function", m.group("name")) if (m := _RUST.match(line)) else None
    if lang == "go":
        return ("method" if m.group("receiver") else "function", m.group("name")) if (m := _GO.match(line)) else None
    s = line.strip()
    if "(" not in s or s.endswith((";", ":")) or s[0] in "#[/*{}=.:?&|+-(,)":
        return None
    word = re.match(r"[A-Za-z_]\w*", s)
    if word and word.group() in _NOT_FUNCTIONS:
        return None
    m = _NAME_BEFORE_PAREN.search(s)
    if not m or "=" in s[: m.start()] or not s[: m.start()].strip() and not s.endswith(("{", ")")):
        return None
    return ("method" if "::" in s[: m.end()] else "function", m.group(1)) if m.group(1) not in _NOT_FUNCTIONS else None


def _block(lines: list[str], lang: str, raw: list[str]) -> list[tuple]:
    out, i = [], 0
    while i < len(lines):
        head = _header(lines[i], lang)
        if not head:
            i += 1
            continue
        depth, paren, begun, end = 0, 0, False, None
        for j in range(i, len(lines)):
            for c in lines[j]:
                if c in "([":
                    paren += 1
                elif c in ")]":
                    paren -= 1
                elif c == "{":
                    begun, depth = True, depth + 1
                elif c == "}":
                    depth -= 1
                elif c == ";" and not begun and paren <= 0:
                    end = -1
                    break
                if begun and depth <= 0:
                    end = j
                    break
            if end is not None:
                break
        if end is None or end < 0:
            i += 1
            continue
        out.append((*head, i + 1, end + 1))
        i = end + 1
    return out


def _script(lines: list[str], lang: str, raw: list[str]) -> list[tuple]:
    """One function at a time: a line with ``function`` or ``=>`` and an opening brace."""
    out, i = [], 0
    while i < len(lines):
        line = lines[i]
        if "{" not in line or ("function " not in line and "=>" not in line):
            i += 1
            continue
        m = _SCRIPT_NAME.search(line)
        end = _balanced(lines, i)
        out.append(("function", next((g for g in m.groups() if g), "anonymous") if m else "anonymous", i + 1, end + 1))
        i = end + 1
    return out


def _balanced(lines: list[str], at: int) -> int:
    """The line on which the braces opened since ``at`` are closed again."""
    depth = 0
    for j in range(at, len(lines)):
        depth += lines[j].count("{") - lines[j].count("}")
        if depth <= 0:
            return j
    return len(lines) - 1


def _width(indent: str) -> int:
    n = 0
    for c in indent:
        n = n // 8 * 8 + 8 if c == "\t" else n + 1
    return n


def _python(lines: list[str], lang: str, raw: list[str]) -> list[tuple]:
    out, open_ = [], []
    continued = 0  # inside brackets a line's indent says nothing
    for i, line in enumerate(lines):
        s = line.strip()
        literal = not s and raw[i].strip() and not raw[i].strip().startswith("#")
        if s and not continued and not literal:
            width = _width(line[: len(line) - len(line.lstrip())])
            while open_ and width <= open_[-1][0]:
                out.append((*open_.pop()[1:], i))
            if m := _PYTHON.match(line):
                open_.append((width, "async-function" if m.group("late") else "function", m.group("name"), i + 1))
        continued = max(0, continued + sum(line.count(c) for c in "([{") - sum(line.count(c) for c in ")]}"))
    n = len(lines)
    if n > 1 and not lines[-1]:
        n -= 1
    out += [(*o[1:], n) for o in reversed(open_)]
    return sorted(out, key=lambda x: x[2])


def _shell(lines: list[str], lang: str, raw: list[str]) -> list[tuple]:
    out, i = [], 0
    while i < len(lines):
        if m := _SHELL.match(lines[i]):
            end = _balanced(lines, i)
            out.append(("function", m.group("a") or m.group("b"), i + 1, end + 1))
            i = end
        i += 1
    return out


def _qml(lines: list[str], lang: str, raw: list[str]) -> list[tuple]:
    out = []
    for i, line in enumerate(lines):
        for pattern, kind in _QML:
            if m := pattern.match(line):
                if "{" in line or i + 1 < len(lines) and lines[i + 1].strip().startswith("{"):
                    at = i if "{" in line else i + 1
                    out.append((kind, m.group(1), i + 1, _balanced(lines, at) + 1))
                break
    return out
