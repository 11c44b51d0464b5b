"""Constant strings of scripts: literals put together by ``+``, templates and ``join``.

Top-level constants that are bound once and never shadowed are known by name;
folding goes on until nothing new is found.
"""

from __future__ import annotations

import re

from .comments import mask_comments, mask_literals
from .languages import language

_LITERAL = r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`"
_CONST = re.compile(r"^(?:export\s+)?const\s+([A-Za-z_$][\w$]*)\s*(?::\s*string\s*)?=\s*(.+?);?\s*$", re.M)
_TERM = re.compile(rf"\s*(?P<lit>{_LITERAL})|\s*(?P<name>[A-Za-z_$][\w$]*)(?![\w$]*\s*[(.\[])|\s*(?P<list>\[[^\[\]]*\])\s*\.join\(\s*(?P<sep>{_LITERAL})?\s*\)")
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "0": "\0"}


def _plain(literal: str, known: dict[str, str]) -> str | None:
    """The value of a literal; None for a template that holds something unknown."""
    body = re.sub(r"\\(?:u\{([0-9A-Fa-f]+)\}|u([0-9A-Fa-f]{4})|x([0-9A-Fa-f]{2})|(.))", lambda m: chr(int(m.group(1) or m.group(2) or m.group(3), 16)) if m.group(4) is None else _ESCAPES.get(m.group(4), m.group(4)), literal[1:-1], flags=re.S)
    if literal[0] != "`":
        return body
    out, at = "", 0
    for m in re.finditer(r"\$\{\s*([^{}]*?)\s*\}", body):
        value = known.get(m.group(1)) if re.fullmatch(r"[A-Za-z_$][\w$]*", m.group(1)) else fold_expression(m.group(1), known)
        if value is None:
            return None
        out += body[at : m.start()] + value
        at = m.end()
    return out + body[at:]


def _term(text: str, at: int, known: dict[str, str]) -> tuple[str, int] | None:
    m = _TERM.match(text, at)
    if not m:
        return None
    if m.group("lit"):
        value = _plain(m.group("lit"), known)
    elif m.group("name"):
        value = known.get(m.group("name"))
    else:
        items = [fold_expression(x, known) for x in re.split(r",(?=(?:[^\"'`]|\"[^\"]*\"|'[^']*'|`[^`]*`)*$)", m.group("list")[1:-1]) if x.strip()]
        sep = _plain(m.group("sep"), known) if m.group("sep") else ","
        value = None if None in items or sep is None else sep.join(items)
    return None if value is None else (value, m.end())


def fold_expression(text: str, known: dict[str, str]) -> str | None:
    """The value of a whole expression of terms joined by ``+``; None if any part is unknown."""
    out, at = "", 0
    while True:
        found = _term(text, at, known)
        if found is None:
            return None
        out += found[0]
        at = found[1]
        if not text[at:].strip():
            return out
        plus = re.match(r"\s*\+(?![+=])", text[at:])
        if not plus:
            return None
        at += plus.end()


def folded_strings(text: str, ext: str) -> list[str]:
    """Values of the put-together expressions of a script, single literals left out."""
    if language(ext) != "script":
        return []
    code = mask_comments(text, ext)
    bound = re.findall(r"\b(?:const|let|var|function|class)\s+([A-Za-z_$][\w$]*)", mask_literals(text, ext))
    bound += [n for args in re.findall(r"\(([^()]*)\)\s*(?:=>|\{)", mask_literals(text, ext)) for n in re.findall(r"[A-Za-z_$][\w$]*", args)]
    consts = [(n, v) for n, v in _CONST.findall(code) if bound.count(n) == 1]
    known: dict[str, str] = {}
    while True:
        new = {n: x for n, v in consts if n not in known and (x := fold_expression(v, known)) is not None}
        if not new:
            break
        known |= new
    out, at = [], 0
    while m := _TERM.search(code, at):
        first = _term(code, m.start(), known)
        if first is None:
            at = m.end()
            continue
        value, end, parts = first[0], first[1], 1
        while (plus := re.match(r"\s*\+(?![+=])", code[end:])) and (more := _term(code, end + plus.end(), known)):
            value, end, parts = value + more[0], more[1], parts + 1
        if parts > 1 or m.group("list") or (m.group("lit") and m.group("lit")[0] == "`" and "${" in m.group("lit")):
            out.append(value)
        at = max(end, m.end())
    return out
