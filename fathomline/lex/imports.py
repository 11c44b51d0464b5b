"""Module specifiers and imported names of script and style texts."""

from __future__ import annotations

import re

from .comments import mask_literals, spans
from .languages import language

_QUOTED = r"\s*(?P<q>[\"'])(?P<s>(?:[^\"'\\]|\\.|(?!(?P=q))[\"'])*?)(?P=q)"
_FROM = re.compile(r"^\s*(?:import|export)\s.*?\sfrom\s" + _QUOTED)
_BARE = re.compile(r"^\s*import\s" + _QUOTED)
_CALL = re.compile(r"import\(" + _QUOTED)
_SASS = re.compile(r"^\s*@(?P<word>use|forward|import)\b")
_STRING = re.compile(r"(?P<q>[\"'])(?P<s>(?:[^\"'\\]|\\.|(?!(?P=q))[\"'])*?)(?P=q)")
_IDENT = re.compile(r"[A-Za-z_$][\w$]*")


def module_specifiers(text: str, ext: str) -> list[dict]:
    """Specifiers with their code point range; a bare import has the range of its line as well."""
    sass, out, at = language(ext) == "scss", [], 0
    for line in text.splitlines(keepends=True):
        def add(m: re.Match, removable: bool = False, at=at, line=line) -> None:
            out.append({"specifier": m.group("s"), "start": at + m.start("s"), "end": at + m.end("s"), "removal_start": at if removable else None, "removal_end": at + len(line) if removable else None})

        if sass:
            if w := _SASS.match(line):
                hits = list(_STRING.finditer(line, w.end()))
                for m in hits if w.group("word") == "import" else hits[:1]:
                    add(m)
        else:
            if m := _FROM.match(line):
                add(m)
            elif m := _BARE.match(line):
                add(m, removable=True)
            for m in _CALL.finditer(line):
                add(m)
        at += len(line)
    return out


#: Over a text whose literals and comments are blanks: a statement's first word, and what may stand between it and a specifier.
_KEYWORD = re.compile(r"(?<![\w$.])(?:import|export)(?![\w$])")
_CLAUSE = {
    "import": re.compile(r"(?:(?!\b(?:import|export)\b)[\s\w$,{}*])+?(?<=[\s}*])from(?![\w$])"),
    "export": re.compile(r"\s*(?:type\b\s*)?(?:\*(?:\s*as\s+[\w$]+)?|\{[\s\w$,]*\})\s*from(?![\w$])"),
}
_CALL_OPENS = re.compile(r"\s*\(")
_STATEMENT_END = re.compile(r"[ \t]*;?[ \t]*")


def statement_specifiers(text: str, ext: str) -> list[dict]:
    """Specifiers of whole statements: several on a line, over several lines, calls and types of ``import("...")`` too.

    A bare import that has its lines to itself has their range as well.  Style
    texts are read line by line.
    """
    if language(ext) != "script":
        return module_specifiers(text, ext)
    literals = {s.start: s.end for s in spans(text, ext, strict=True) if s.kind == "string"}
    masked, out = mask_literals(text, ext), []

    def literal(at: int, quotes: str) -> tuple[int, int] | None:
        """The whole literal that begins here, after blanks and comments."""
        while at < len(masked) and masked[at].isspace() and at not in literals:
            at += 1
        end = literals.get(at, -1)
        return (at, end) if end - at > 1 and text[at] in quotes and text[end - 1] == text[at] and "${" not in text[at:end] else None

    for m in _KEYWORD.finditer(masked):
        first = last = None
        if m.group() == "import" and (found := literal(m.end(), "\"'")):
            stop, left = _STATEMENT_END.match(text, found[1]).end(), text.rfind("\n", 0, m.start()) + 1
            if not text[left : m.start()].strip() and (stop == len(text) or text[stop] in "\r\n"):
                line = text.find("\n", stop)
                first, last = left, len(text) if line < 0 else line + 1
        elif m.group() == "import" and (call := _CALL_OPENS.match(masked, m.end())):
            found = literal(call.end(), "\"'`")
        else:
            clause = _CLAUSE[m.group()].match(masked, m.end())
            found = literal(clause.end(), "\"'") if clause else None
        if found:
            out.append({"specifier": text[found[0] + 1 : found[1] - 1], "start": found[0] + 1, "end": found[1] - 1, "removal_start": first, "removal_end": last})
    return out


def imported_names(text: str) -> list[str]:
    """Local names bound by import statements, those over several lines included."""
    out, pending = [], ""
    for line in text.splitlines():
        s = line.lstrip()
        if not pending and (not s.startswith("import ") or s[7:].lstrip()[:1] in ("'", '"')):
            continue
        pending = f"{pending} {s}" if pending else s
        if " from " not in pending:
            continue
        clause = re.sub(r"^type\s+", "", pending[7:].split(" from ")[0].strip()).strip()
        pending = ""
        default, brace, named = clause.partition("{")
        if star := re.match(r"\*\s*as\s+(.+)", clause):
            out.append(star.group(1).strip())
            continue
        if head := default.split(",")[0].strip():
            out.append(head)
        if brace:
            out += [p.split()[-1] for p in named.rstrip("; ").rstrip("}").split(",") if p.split()]
    return out


def used_identifiers(text: str) -> list[str]:
    """Distinct identifiers outside lines that begin an import."""
    return sorted({w for line in text.splitlines() if not line.lstrip().startswith("import ") for w in _IDENT.findall(line)})


def resolution_candidates(folder: str, specifier: str, ext: str, extensions: list[str]) -> list[str]:
    """Paths a relative specifier may mean, the first that exists wins.

    Empty if the specifier leaves the root.
    """
    parts = [p for p in folder.split("/") if p]
    for p in specifier.split("/"):
        if p in ("", "."):
            continue
        if p == "..":
            if not parts:
                return []
            parts.pop()
        else:
            parts.append(p)
    base = "/".join(parts)
    if language(ext) == "scss":
        name = parts[-1] if parts else ""
        above = "/".join(parts[:-1])
        at = lambda f, n: f"{f}/{n}" if f else n
        return [f"{base}.scss", at(above, f"_{name}.scss"), at(base, "index.scss"), at(base, "_index.scss")]
    out = [base]
    if m := re.search(r"\.(?:js|jsx|mjs|cjs)$", base, re.I):
        out += [base[: m.start()] + e for e in extensions]
    out += [base + e for e in extensions]
    return out + [(f"{base}/" if base else "") + f"index{e}" for e in extensions]
