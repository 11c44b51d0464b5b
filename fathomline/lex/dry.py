"""Normal form of a function's source, in which renamed copies are equal."""

from __future__ import annotations

import re

from .comments import mask_comments
from .functions import function_spans
from .languages import language

# fixed values: words that keep their place in the normal form, and what stands for the function's name
KEYWORDS = ("async", "class", "const", "def", "fn", "func", "function", "if", "let", "local", "pub", "return", "static", "struct", "type", "var", "void")
PLACEHOLDER = "__dry_function"
#: Shortest normal form that counts as a duplicate, by language.
LEAST_CHARACTERS = 40

_HEADERS = {
    "go": r"(?<=func )[A-Za-z0-9_$]+", "python": r"(?<=def )[A-Za-z0-9_$]+", "qml": r"(?<=function )[A-Za-z0-9_$]+",
    "shell": r"(?<![^\s])[A-Za-z0-9_-]+", "rust": r"(?<=fn )[A-Za-z0-9_$]+", "script": r"(?<=fn )[A-Za-z0-9_$]+|(?<=function )[A-Za-z0-9_$]+",
    "cpp": r"[A-Za-z0-9_]+(?=\()", "csharp": r"[A-Za-z0-9_]+(?=\()",
}
_TOKEN = re.compile(r"(?P<str>\"(?:[^\"\\]|\\.)*(?:\"|\Z)|'(?:[^'\\]|\\.)*(?:'|\Z)|`(?:[^`\\]|\\.)*(?:`|\Z))|(?P<num>[0-9][A-Za-z0-9.]*)|(?P<word>[A-Za-z_$][A-Za-z0-9_$]*)|(?P<gap>\s+)|(?P<sign>.)", re.S)


def normal_form(source: str, ext: str) -> str:
    first, nl, rest = source.partition("\n")
    pattern = _HEADERS.get(language(ext))
    if pattern:
        first = re.sub(pattern, PLACEHOLDER, first, count=1)
    tokens = [(m.lastgroup, m.group()) for m in _TOKEN.finditer(mask_comments(first + nl + rest, ext)) if m.lastgroup != "gap"]
    numbers: dict[str, str] = {}
    out = []
    for k, (kind, value) in enumerate(tokens):
        if kind == "str":
            out.append("STR:" + value)
        elif kind == "num":
            out.append("NUM:" + value)
        elif kind == "word":
            after = tokens[k + 1][1][0] if k + 1 < len(tokens) else ""
            fixed = (k and tokens[k - 1][1][-1] == ".") or after in ("(", "!") or value[0].isupper()
            if value.lower() in KEYWORDS:
                out.append(value.lower())
            else:
                out.append(value if fixed else numbers.setdefault(value, f"i{len(numbers)}"))
        else:
            out.append(value)
    return "".join(out)


def language_key(ext: str) -> str:
    lang = language(ext)
    return "typescript" if lang == "script" else lang


def descriptors(text: str, ext: str, spans: list[dict] | None = None) -> list[dict]:
    """One per function: name, language, classification, start line, size, fingerprint."""
    lines, out = text.split("\n"), []
    for s in spans if spans is not None else function_spans(text, ext):
        source = "\n".join(lines[s["start_line"] - 1 : s["end_line"]]).rstrip("\r\n")
        norm = normal_form(source, ext)
        key = language_key(ext)
        out.append({"name": s["name"], "language": key, "classification": "method" if s["kind"] in ("method", "signal-handler") else "standalone",
                    "start_line": s["start_line"], "character_count": len(norm), "fingerprint": f"{key}:{norm}"})
    return out
