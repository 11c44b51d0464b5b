"""Comment and literal ranges, and the texts masked by them.

One pass per text: at each place where a literal or comment may begin, the
language's patterns are tried in order.  Offsets are code points.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

from .languages import language


@dataclass(frozen=True)
class Span:
    start: int
    end: int
    kind: str  # line, block, string


_DOUBLE = r'"(?:[^"\\]|\\.)*(?:"|\Z)'
_SINGLE = r"'(?:[^'\\]|\\.)*(?:'|\Z)"
_BACK = r"`(?:[^`\\]|\\.)*(?:`|\Z)"
_LINE = r"//[^\n]*"
_BLOCK = r"/\*.*?(?:\*/|\Z)"
# in the strict mask a plain quote ends with its line
_DOUBLE1 = r'"(?:[^"\\\n]|\\.)*(?:"|(?=\n)|\Z)'
_SINGLE1 = r"'(?:[^'\\\n]|\\.)*(?:'|(?=\n)|\Z)"
_CPP_RAW = r'(?:u8|[uUL])?R"(?P<d>[^()\\\s]{0,16})\(.*?(?:\)(?P=d)"|\Z)'
_CS_VERBATIM = r'(?:\$@|@\$|@)"(?:[^"]|"")*(?:"|\Z)'
_RUST_RAW = r'\bb?r(?P<h>#*)".*?(?:"(?P=h)|\Z)'
_RUST_CHAR = r"b?'(?:\\(?:u\{[0-9A-Fa-f_]*\}|x[0-9A-Fa-f]{2}|.)|[^'\\\n])'"
_PY_TRIPLE = r"(?i:\b[rbuft]{1,2}|)(?:\"\"\"(?:[^\\]|\\.)*?(?:\"\"\"|\Z)|'''(?:[^\\]|\\.)*?(?:'''|\Z))"
_PY_PLAIN = r"(?i:\b[rbuft]{1,2}|)(?:" + _DOUBLE1 + "|" + _SINGLE1 + ")"

# fixed values: words after which a slash begins a regular expression
REGEX_WORDS = ("case", "delete", "do", "else", "in", "instanceof", "new", "of", "return", "throw", "typeof", "void", "yield")


@lru_cache
def _pattern(lang: str, strict: bool) -> re.Pattern:
    double, single = (_DOUBLE1, _SINGLE1) if strict else (_DOUBLE, _SINGLE)
    plain = f"(?P<string>{double}|{single})"
    by = {
        "script": rf"(?P<line>{_LINE})|(?P<block>{_BLOCK})|(?P<string>{double}|{single}|{_BACK})|(?P<slash>/)",
        "qml": rf"(?P<line>{_LINE})|(?P<block>{_BLOCK})|(?P<string>{double}|{single}|{_BACK})|(?P<slash>/)",
        "go": rf"(?P<line>{_LINE})|(?P<block>{_BLOCK})|(?P<string>{double}|{single}|`[^`]*(?:`|\Z))",
        "css": rf"(?P<line>{_LINE})|(?P<block>{_BLOCK})|{plain}",
        "scss": rf"(?P<line>{_LINE})|(?P<block>{_BLOCK})|{plain}",
        "rust": rf"(?P<line>{_LINE})|(?P<nest>/\*)|(?P<string>{_RUST_RAW}|{_RUST_CHAR}|b?{double})",
        "cpp": rf"(?P<line>{_LINE})|(?P<block>{_BLOCK})|(?P<string>{_CPP_RAW}|{double}|(?<![0-9A-Fa-f]){single})",
        "csharp": rf"(?P<line>{_LINE})|(?P<block>{_BLOCK})|(?P<string>{_CS_VERBATIM}|\$?{double}|{single})",
        "python": rf"(?P<line>#[^\n]*)|(?P<string>{_PY_TRIPLE}|{_PY_PLAIN})",
    }
    return re.compile(by[lang], re.S)


_REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*\])+/[A-Za-z]*")


def _regex_end(text: str, at: int) -> int:
    """The end of a regular expression that begins at a slash, or -1."""
    m = _REGEX.match(text, at)
    return m.end() if m else -1


def _regex_may_begin(text: str, at: int) -> bool:
    before = text[max(0, at - 200) : at].rstrip()
    if not before:
        return True
    if before[-1] in "([{,;:=!&|?+-*%^~<>":
        return True
    word = re.search(r"[A-Za-z_$][\w$]*\Z", before)
    return bool(word) and word.group() in REGEX_WORDS


@lru_cache(64)
def spans(text: str, ext: str, strict: bool = False) -> tuple[Span, ...]:
    """Comments and literals in order; strict ends plain quotes with their line.

    The passes over one text ask for the same spans again and again, so the
    last ones are kept.
    """
    lang = language(ext)
    if lang == "shell":
        return tuple(_shell(text))
    if not lang:
        return ()
    out, at, pattern = [], 0, _pattern(lang, strict)
    while m := pattern.search(text, at):
        kind, start, end = m.lastgroup, m.start(), m.end()
        kind = next(k for k in ("line", "block", "string", "slash", "nest") if k in m.groupdict() and m.group(k) is not None)
        if kind == "slash":
            end = _regex_end(text, start) if _regex_may_begin(text, start) else -1
            at = end if end > 0 else start + 1
            if end > 0:
                out.append(Span(start, end, "string"))
            continue
        if kind == "nest":
            depth, end = 0, len(text)
            for t in re.compile(r"/\*|\*/").finditer(text, start):
                depth += 1 if t.group() == "/*" else -1
                if not depth:
                    end = t.end()
                    break
            kind = "block"
        out.append(Span(start, end, kind))
        at = max(end, start + 1)
    return tuple(out)


_HEREDOC = re.compile(r"<<(?P<dash>-?)\s*(?P<q>['\"]?)\\?(?P<word>[A-Za-z_]\w*)(?P=q)")
_SHELL = re.compile(r"""\\.|(?P<string>'[^'\n]*(?:'|(?=\n)|\Z)|"(?:[^"\\\n]|\\.)*(?:"|(?=\n)|\Z)|`(?:[^`\\\n]|\\.)*(?:`|(?=\n)|\Z))|(?P<here><<-?\s*['"]?\\?[A-Za-z_]\w*['"]?)|(?P<line>\#[^\n]*)""", re.S)


def _shell(text: str) -> list[Span]:
    """Quotes end with their line, ``#`` counts at a boundary only, here-documents are literals."""
    out, at, waiting = [], 0, []
    for line in text.splitlines(keepends=True):
        end = at + len(line)
        if waiting:
            word, dash = waiting[0]
            body = line.rstrip("\r\n")
            if (body.lstrip("\t") if dash else body) == word:
                waiting.pop(0)
            else:
                out.append(Span(at, end, "string"))
            at = end
            continue
        for m in _SHELL.finditer(line):
            if m.group("string") is not None:
                out.append(Span(at + m.start(), at + m.end(), "string"))
            elif m.group("here") is not None and line[m.end() - 1 : m.end()] != "<" and not line[: m.start()].endswith("<"):
                h = _HEREDOC.match(line, m.start())
                if h:
                    waiting.append((h.group("word"), h.group("dash") == "-"))
            elif m.group("line") is not None:
                if m.start() == 0 or line[m.start() - 1] in " \t;|&()":
                    out.append(Span(at + m.start(), at + len(line.rstrip("\r\n")), "line"))
                    break
        at = end
    return out


_CODING = re.compile(r"^[ \t\f]*#.*?coding[:=][ \t]*[-\w.]+")


def comment_ranges(text: str, ext: str) -> list[Span]:
    """Removable comments: not a shebang at the top, nor Python's coding comment."""
    lang, out = language(ext), []
    for s in spans(text, ext):
        if s.kind == "string":
            continue
        if s.start == 0 and text.startswith("#!"):
            continue
        if lang == "python" and text.count("\n", 0, s.start) < 2 and _CODING.match(text[s.start : s.end]):
            continue
        out.append(s)
    return out


def _blank(text: str, found) -> str:
    parts, at = [], 0
    for s in found:
        parts += [text[at : s.start], re.sub(r"[^\n]", " ", text[s.start : s.end])]
        at = s.end
    return "".join([*parts, text[at:]])


@lru_cache(64)
def mask_comments(text: str, ext: str) -> str:
    """Comments as blanks, line breaks kept; what counts as code lines."""
    return _blank(text, [s for s in spans(text, ext) if s.kind != "string"])


@lru_cache(64)
def mask_literals(text: str, ext: str) -> str:
    """Literals and comments as blanks."""
    return _blank(text, spans(text, ext, strict=True))


def mask_code(text: str) -> str:
    """C-style comments and all quotes as blanks, whatever the language."""
    return _blank(text, [Span(m.start(), m.end(), "string") for m in re.compile(rf"{_LINE}|{_BLOCK}|{_DOUBLE}|{_SINGLE}|{_BACK}", re.S).finditer(text)])


@lru_cache(64)
def literal_lines(text: str, ext: str) -> list[tuple[bool, bool]]:
    """For every line whether it starts, and whether it ends, inside a literal."""
    breaks = [m.start() for m in re.finditer("\n", text)]
    n = len(breaks) + 1
    starts, ends = [False] * n, [False] * n
    for s in spans(text, ext, strict=True):
        if s.kind != "string":
            continue
        for k in range(_line_of(breaks, s.start), _line_of(breaks, s.end - 1)):
            ends[k] = True
            starts[k + 1] = True
    return list(zip(starts, ends, strict=True))


def _line_of(breaks: list[int], at: int) -> int:
    from bisect import bisect_left

    return bisect_left(breaks, at)


def strip_comments(text: str, ext: str, keep: tuple[str, ...] = ()) -> tuple[str, int, int]:
    """The text without comments, and how many line and block comments went.

    A comment that stands alone takes its lines with it; a block comment inside
    a line leaves one blank, or its line breaks.  Comments that hold one of the
    keep strings stay.
    """
    out, at, n_line, n_block = [], 0, 0, 0
    for s in comment_ranges(text, ext):
        body = text[s.start : s.end]
        if any(k in body for k in keep if k):
            continue
        n_line += s.kind == "line"
        n_block += s.kind == "block"
        left = text.rfind("\n", 0, s.start) + 1
        right = text.find("\n", s.end)
        right = len(text) if right < 0 else right
        alone = not text[left : s.start].strip() and not text[s.end : right].strip() and left >= at
        if alone:
            out.append(text[at:left])
            at = min(right + 1, len(text))
        elif s.kind == "block":
            breaks = body.count("\n")
            out += [text[at : s.start], "\n" * breaks or " "]
            at = s.end
        else:
            kept = text[at : s.start]
            out.append(kept.rstrip(" \t"))
            at = s.end
    return "".join(out) + text[at:], n_line, n_block
