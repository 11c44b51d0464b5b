"""Text formatting in passes that end when nothing changes any more.

Literals stay as they are: a line that begins or ends inside one is not
touched, and a change of layout that would alter a literal or the order of
tokens is dropped.
"""

from __future__ import annotations

import re
from functools import lru_cache

from .comments import literal_lines, mask_comments, mask_literals, spans
from .languages import language

LARGE = 2 << 20
_UNIT = {"go": 4, "rust": 4, "python": 4, "csharp": 4}
_JSX = (".tsx", ".jsx")
_TAG = re.compile(r"<[A-Za-z][\w.:-]*(?=\s|$)")
_BINARY = r"===|!==|==|!=|<=|>=|&&=|\|\|=|\?\?=|\+=|-=|\*=|/=|%=|=>|&&|\|\||\?\?|="


def format_text(text: str, ext: str, width: int = 100, rounds: int = 4) -> str:
    """The settled form of a text; texts of unknown languages only get their ends trimmed."""
    for _ in range(rounds):
        new = _once(text, ext, width)
        if new == text:
            break
        text = new
    return text


def _once(text: str, ext: str, width: int) -> str:
    lang = language(ext)
    text = _ends(text, ext)
    if not text or lang == "":
        return text
    if lang == "script" and len(text.encode()) > LARGE:
        return text
    if lang in ("script", "qml") and ext not in _JSX:
        text = _guard(text, ext, _quotes(text, ext) if lang == "script" else text, quotes=True)
        text = _guard(text, ext, _spacing(text, ext))
        if lang == "script":
            text = _guard(text, ext, _semicolons(text, ext), loose=True)
    if lang not in ("python", "shell"):
        text = _indent(text, ext, _UNIT.get(lang, 2))
    for _ in range(4):
        new = _wrap(text, ext, width)
        if new == text or _literals(new, ext) != _literals(text, ext):
            break
        text = new if lang in ("python", "shell") else _indent(new, ext, _UNIT.get(lang, 2))
    return _ends(text, ext)


def _locked(text: str, ext: str) -> list[bool]:
    return [a or b for a, b in literal_lines(text, ext)]


def _ends(text: str, ext: str) -> str:
    """One kind of line end, no blanks at line ends, single blank lines, one final break."""
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    lines, locked, out = text.split("\n"), _locked(text, ext), []
    for line, keep in zip(lines, locked, strict=True):
        if not keep:
            line = line.rstrip()
            if not line and (not out or out[-1] == ""):
                continue
        out.append(line)
    while out and out[-1] == "":
        out.pop()
    return "\n".join(out) + "\n" if out else ""


def _indent(text: str, ext: str, unit: int) -> str:
    lines, masked, locked = text.split("\n"), mask_literals(text, ext).split("\n"), _locked(text, ext)
    flags = literal_lines(text, ext)
    out, depth, goes_on, in_tag = [], 0, False, False
    for line, m, keep, (inside, _) in zip(lines, masked, locked, flags, strict=True):
        code = m.strip()
        attribute = in_tag and not code.startswith((">", "/>"))
        opens = sum(code.count(c) for c in "{[(")
        closes = sum(code.count(c) for c in "}])")
        leading = len(re.match(r"[}\])]*", code).group())
        if inside or not line.strip():
            out.append(line)
        elif keep:  # begins here, ends in a later line: only its indent may move
            out.append(" " * (unit * max(0, depth - leading)) + line.lstrip())
        else:
            level = max(0, depth - leading + (1 if goes_on or attribute else 0))
            out.append(" " * (unit * level) + line.strip())
        depth = max(0, depth + opens - closes)
        goes_on = code.endswith(("+", "&&", "||")) and not code.endswith("++")
        in_tag = ext in _JSX and (in_tag or bool(_TAG.match(code))) and not re.search(r"(?<!=)>", code)
    return "\n".join(out)


def _quotes(text: str, ext: str) -> str:
    out, at = [], 0
    for s in spans(text, ext, strict=True):
        body = text[s.start : s.end]
        if s.kind == "string" and len(body) > 1 and body[0] == body[-1] == "'" and '"' not in body and "\\" not in body:
            out += [text[at : s.start], '"' + body[1:-1] + '"']
            at = s.end
    return "".join(out) + text[at:]


def _semicolons(text: str, ext: str) -> str:
    masked, lines, locked = mask_literals(text, ext).split("\n"), text.split("\n"), _locked(text, ext)
    commented = mask_comments(text, ext).split("\n")
    depth, out = 0, []
    for i, (line, code) in enumerate(zip(lines, masked, strict=True)):
        s = code.strip()
        depth = max(0, depth + sum(code.count(c) for c in "([") - sum(code.count(c) for c in ")]"))
        full = commented[i].rstrip()
        following = next((m.strip() or c.strip() for m, c in zip(masked[i + 1 :], commented[i + 1 :], strict=True) if c.strip()), "")
        statement = re.match(r"\s*(?:(?:export\s+)?(?:const|let|var)\s|return\b|throw\b|import\s|export\s+(?:\*|\{.*\})\s*from|[\w$.\]]+(?:\(.*\))$|[\w$.]+\s*(?:=|\+=|-=)\s)", commented[i])
        if statement and full and not locked[i] and not depth and full[-1] not in "{;,([:=+-*/&|?.>" and not re.match(r"[.?+\-*/&|,)\]:=({`\[]", following) and full == line.rstrip() and s[-1:] != "{":
            line = line.rstrip() + ";"
        out.append(line)
    return "\n".join(out)


def _spacing(text: str, ext: str) -> str:
    parts, at = [], 0
    for s in spans(text, ext, strict=True):
        parts += [_space_code(text[at : s.start]), text[s.start : s.end]]
        at = s.end
    return "".join([*parts, _space_code(text[at:])])


def _space_code(code: str) -> str:
    out = []
    for k, line in enumerate(code.split("\n")):
        lead = re.match(r"[ \t]*", line).group() if k else ""
        body = line[len(lead) :]
        body = re.sub(rf"(?<=[\w)\]}}\"'`])[ \t]*(?<![<>=!+\-*/%&|?])({_BINARY})(?![=>&|?])[ \t]*(?=\S|$)", r" \1 ", body)
        body = re.sub(r",(?=[^\s,\])}])", ", ", body)
        body = re.sub(r"[ \t]+([,;])", r"\1", body)
        body = re.sub(r"\)\{", ") {", body)
        body = re.sub(r"\b(if|for|while|switch|catch)\(", r"\1 (", body)
        out.append(lead + body)
    return "\n".join(out)


@lru_cache(64)
def _tokens(text: str, ext: str) -> list[str]:
    """Code without white space, literals whole, in order."""
    out, at = [], 0
    for s in spans(text, ext, strict=True):
        out += re.findall(r"\w+|[^\w\s]", text[at : s.start])
        out.append(text[s.start : s.end])
        at = s.end
    return out + re.findall(r"\w+|[^\w\s]", text[at:])


@lru_cache(64)
def _literals(text: str, ext: str) -> str:
    """All literal content run together, quotes and joins aside."""
    return "".join(re.sub(r"^[\w#@$]*[\"'`]+|[\"'`]+#*$", "", text[s.start : s.end]) for s in spans(text, ext, strict=True) if s.kind == "string")


def _guard(old: str, ext: str, new: str, quotes: bool = False, loose: bool = False) -> str:
    """new, unless it differs from old in more than layout."""
    a, b = _tokens(old, ext), _tokens(new, ext)
    if loose:
        a, b = [t for t in a if t != ";"], [t for t in b if t != ";"]
    if quotes:
        a, b = [t.strip("'\"") for t in a], [t.strip("'\"") for t in b]
    return new if a == b else old


def _wrap(text: str, ext: str, width: int) -> str:
    lines, locked, lang = text.split("\n"), _locked(text, ext), language(ext)
    masked = mask_literals(text, ext).split("\n")
    commented = mask_comments(text, ext).split("\n")
    out, changed = [], False
    for line, keep, code, plain in zip(lines, locked, masked, commented, strict=True):
        expand = lang == "qml" and re.match(r"\s*[\w.]+\s*\{.*\S.*\}\s*$", code) or lang == "script" and code.count(";") > 1 and re.search(r"\{[^{}]*;[^{}]*;?[^{}]*\}\s*$", code) and "for" not in code
        if keep or (len(line) <= width and not expand):
            out.append(line)
            continue
        new = None
        if not plain.strip() and line.strip():
            new = _wrap_comment(line, width)
        elif expand:
            new = _expand(line, code)
        else:
            new = _wrap_delimited(line, code, lang) or _wrap_sum(line, code, plain, lang) or _wrap_string(line, code, lang, width) or _wrap_tag(line, width)
        if new and new != [line]:
            changed = True
            out += new
        else:
            out.append(line)
    return "\n".join(out) if changed else text


def _wrap_comment(line: str, width: int) -> list[str] | None:
    m = re.match(r"(\s*)(//+|#+|\*)(\s+)(.*)$", line)
    if not m or m.group(4).startswith("!"):
        return None
    head, words, out, now = m.group(1) + m.group(2) + m.group(3), m.group(4).split(), [], ""
    for w in words:
        if now and len(head) + len(now) + 1 + len(w) > width:
            out.append(head + now)
            now = w
        else:
            now = f"{now} {w}" if now else w
    return [*out, head + now] if now else None


def _wrap_delimited(line: str, code: str, lang: str) -> list[str] | None:
    """A list in brackets over several lines, cut at its top-level commas."""
    if lang in ("python", "shell", "css", "scss"):
        return None
    best = None
    for m in re.finditer(r"[(\[]", code):
        depth, cuts = 0, []
        for k in range(m.start(), len(code)):
            if code[k] in "([{":
                depth += 1
            elif code[k] in ")]}":
                depth -= 1
                if not depth:
                    if cuts and (best is None or k - m.start() > best[1] - best[0]):
                        best = (m.start(), k, cuts)
                    break
            elif code[k] == "," and depth == 1:
                cuts.append(k)
    if best is None:
        return None
    a, b, cuts = best
    lead = re.match(r"\s*", line).group()
    edges = [a, *cuts, b]
    parts = [line[x + 1 : y].strip() for x, y in zip(edges, edges[1:], strict=False)]
    inner = [lead + "  " + p + ("," if i < len(parts) - 1 else "") for i, p in enumerate(parts) if p]
    return [line[: a + 1].rstrip(), *inner, lead + line[b:].strip()]


def _wrap_sum(line: str, code: str, plain: str, lang: str) -> list[str] | None:
    """A sum with one term a line, cut at every ``+`` outside of brackets and literals."""
    if lang not in ("script", "qml", "cpp", "csharp") or "+=" in code or "++" in code or plain != line or re.match(r"\s*(?:import\b|export\b.*\bfrom\b|#include\b)", code):
        return None
    depth, cuts = 0, []
    for k, c in enumerate(code):
        depth += (c in "([{") - (c in ")]}")
        if c == "+" and depth <= 0 and not re.search(r"\d[eE]$", code[:k]):
            cuts.append(k)
    lead = re.match(r"\s*", line).group()
    terms = [line[a + 1 : b].strip() for a, b in zip([-1, *cuts], [*cuts, len(line)], strict=True)]
    if len(terms) < 2 or not all(terms):
        return None
    return [lead + ("  " if i else "") + t + (" +" if i < len(terms) - 1 else "") for i, t in enumerate(terms)]


def _tag_parts(text: str) -> list[str] | None:
    """The name and the attributes of the tag a text begins with; what follows the tag stays with the last."""
    parts, at, depth, quote, start = [], 0, 0, "", 0
    while at < len(text):
        c = text[at]
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'" or c == "`" and depth:
            quote = c
        elif c == ">" and not depth:
            return [*parts, text[start:]]
        elif c.isspace() and not depth:
            parts.append(text[start:at])
            start = at + 1
        if not quote:
            depth += (c == "{") - (c == "}")
        at += 1
    return None


def _wrap_tag(line: str, width: int) -> list[str] | None:
    """A long tag with its attributes on lines of their own, as many on one as fit."""
    lead, text = re.match(r"(\s*)(.*)", line).groups()
    parts = [p for p in _tag_parts(text) or [] if p] if _TAG.match(text) else []
    if len(parts) < 2:
        return None
    out = [lead + parts[0]]
    for p in parts[1:]:
        if len(out) > 1 and len(out[-1]) + 1 + len(p) <= width:
            out[-1] += " " + p
        else:
            out.append(f"{lead}  {p}")
    return out if all(len(x) <= width for x in out) else None


def _expand(line: str, code: str) -> list[str] | None:
    a, b = code.find("{"), code.rfind("}")
    if a < 0 or b < a or code.count("{") != 1:
        return None
    lead = re.match(r"\s*", line).group()
    cuts = [k for k in range(a, b) if code[k] == ";"]
    edges = [a, *cuts, b]
    parts = [line[x + 1 : y + (1 if y in cuts else 0)].strip() for x, y in zip(edges, edges[1:], strict=False)]
    return [line[: a + 1].rstrip(), *(lead + "  " + p for p in parts if p), lead + line[b:].strip()]


def _wrap_string(line: str, code: str, lang: str, width: int) -> list[str] | None:
    """A long plain literal as several, joined the way the language has."""
    hits = [m for m in re.finditer(r'"([^"\\]*)"', line) if not code[m.start() : m.end()].strip()]
    hit = max(hits, key=lambda m: m.end() - m.start(), default=None)
    if hit is None or " " not in hit.group(1) or lang not in ("qml", "csharp", "cpp", "python"):
        return None
    lead = re.match(r"\s*", line).group() + " " * (_UNIT.get(lang, 2))
    room, pieces, now = max(8, width - len(lead) - 5), [], ""
    for w in re.findall(r"\S+\s*|\s+", hit.group(1)):
        if now and len(now) + len(w) > room:
            pieces.append(now)
            now = ""
        now += w
    pieces.append(now)
    if len(pieces) < 2:
        return None
    quoted = [f'"{p}"' for p in pieces]
    before, after = line[: hit.start()], line[hit.end() :]
    if lang == "python":
        return [before + "(", *(lead + q for q in quoted), lead[: -_UNIT["python"]] + ")" + after]
    join = "" if lang == "cpp" else " +"
    return [before.rstrip(), *(lead + q + (join if i < len(quoted) - 1 else after) for i, q in enumerate(quoted))]


def split_long_strings(text: str, ext: str, width: int) -> str:
    """Script lines over the width whose plain literal may be joined from parts.

    Only for a value after ``:`` or ``=``, an argument, an element or a return;
    left alone are directives, specifiers, escapes, words without a blank, lines
    with a comment and generated or minified files.
    """
    if language(ext) != "script":
        return text
    code, plain, out = mask_literals(text, ext).split("\n"), mask_comments(text, ext).split("\n"), []
    for line, c, p in zip(text.split("\n"), code, plain, strict=True):
        hits = [m for m in re.finditer(r"(\"[^\"\\\n]*\"|'[^'\\\n]*')", line) if not c[m.start() : m.end()].strip()]
        if len(line) <= width or len(hits) != 1 or p != line or re.match(r"\s*(?:import|export)\b", line) or "import(" in line:
            out.append(line)
            continue
        m = hits[0]
        before, body, quote, after = line[: m.start()], m.group()[1:-1], m.group()[0], line[m.end() :]
        fine = re.search(r"(?:[:=(,\[]|\breturn)\s*$|^\s*$", before) and re.match(r"\s*[,;)\]}]*\s*[;,]?\s*$", after) and before.strip()
        lead = re.match(r"\s*", line).group() + "  "
        room, pieces, now = width - len(lead) - 4 - len(after), [], ""
        for w in re.findall(r"\S+\s*|\s+", body):
            if now and len(now) + len(w) > room:
                pieces.append(now)
                now = ""
            now += w
        pieces.append(now)
        parts = [f"{lead}{quote}{x}{quote}" + (" +" if i < len(pieces) - 1 else after) for i, x in enumerate(pieces)]
        whole = [before.rstrip(), *parts]
        if re.search(r"\breturn\s*$", before):
            whole = [before.rstrip() + " (", *parts[:-1], f"{lead}{quote}{pieces[-1]}{quote}", lead[:-2] + ")" + after]
        if fine and len(pieces) > 1 and all(len(x) <= width for x in whole):
            out += whole
        else:
            out.append(line)
    return "\n".join(out)


def generated_source(path: str) -> bool:
    parts = path.split("/")
    return "generated" in parts or ".min." in parts[-1]
