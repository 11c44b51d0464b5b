"""Path functions as columns, and globs as regular expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize(path: Column) -> Column:
    """Forward slashes, no doubled ones, no leading ``./``."""
    return F.regexp_replace(F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), "/+", "/"), r"^(\./)+", "")


def dirname(path: Column) -> Column:
    """What stands before the last slash; the empty string where there is none."""
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit(""))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """The last extension of the name in small letters with its dot, or the empty string."""
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1))


def without_extension(name: Column, ext: Column) -> Column:
    return F.when((F.length(ext) > 0) & F.endswith(F.lower(name), ext), F.left(name, F.length(name) - F.length(ext))).otherwise(name)


def join(folder: Column, name: Column) -> Column:
    return F.when(folder.isin("", "."), name).otherwise(F.concat_ws("/", folder, name))


def dotted(path: Column) -> Column:
    """A target as manifests write it: with ``./`` in front unless it has a dot there."""
    return F.when(F.startswith(path, F.lit(".")), path).otherwise(F.concat(F.lit("./"), path))


def slug(value: Column, fallback: str = "module") -> Column:
    s = F.regexp_replace(F.regexp_replace(F.lower(value), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(s == "", F.lit(fallback)).otherwise(s)


def short_sha1(value: Column) -> Column:
    return F.substring(F.sha1(value.cast("binary")), 1, 12)


def valid_alias(name: Column) -> Column:
    """Not empty, no white space, quotes or NUL, not starting with a dot or slash."""
    return name.rlike(r"^[^\s\"'`\x00./][^\s\"'`\x00]*$")


def token(value: Column) -> Column:
    """A path segment as it is compared: small letters without ``_``, ``-``, blank and tab."""
    return F.lower(F.translate(value, "_- \t", ""))


def singular(value: Column) -> Column:
    t = token(value)
    return F.when((F.length(t) > 1) & F.endswith(t, F.lit("s")), F.left(t, F.length(t) - 1)).otherwise(t)


def _segment(pattern: str) -> str:
    return "".join("[^/]*" if c == "*" else "[^/]" if c == "?" else re.escape(c) for c in pattern)


def clean(path: str) -> str:
    path = re.sub("/+", "/", path.replace("\\", "/"))
    while path.startswith("./"):
        path = path[2:]
    return path


def glob_regex(glob: str) -> str:
    """An anchored expression for a glob.

    ``*`` and ``?`` stay within a segment; ``**`` as a whole segment stands for
    any number of segments, none included, so ``a/**`` matches ``a`` too.
    """
    segments = clean(glob).split("/")
    out = ""  # each part carries the slash in front of it, as the path is read with one
    for s in segments:
        out += "(?:/[^/]*)*" if s == "**" else "/" + _segment(s)
    return out + r"\z"


def glob_matches(path: Column, glob: str) -> Column:
    return F.concat(F.lit("/"), normalize(path)).rlike("^" + glob_regex(glob))


def py_glob_matches(path: str, glob: str) -> bool:
    return re.match(glob_regex(glob).replace(r"\z", r"\Z"), "/" + clean(path)) is not None


def folder_regexes(pattern: str) -> tuple[list[str], list[str]]:
    """Expressions for the folder of a file and for its path, read with a slash in front.

    A bare name matches any folder on the way; otherwise the folder itself, all
    under it, and the pattern as a glob at the root or anywhere below.
    """
    p = clean(pattern).rstrip("/")
    if not p:
        return [], []
    folder, path = [], []
    if "/" not in p:
        folder.append(f"(?:/[^/]*)*/{_segment(p)}(?:/.*)?\\z")
    literal = "/" + re.escape(p)
    folder += [literal + r"(?:/.*)?\z", glob_regex(p), glob_regex("**/" + p)]
    path += [literal + r"(?:/.*)?\z", glob_regex(p + "/**"), glob_regex("**/" + p + "/**")]
    return folder, path


def excluded(path: Column, entries: list[dict]) -> Column:
    """Whether a path falls under any of the {type, pattern} entries."""
    folder, whole = [], []
    for e in entries:
        if e.get("type", "folder") == "file":
            whole.append(glob_regex(e["pattern"]))
        else:
            a, b = folder_regexes(e["pattern"])
            folder += a
            whole += b
    out = F.lit(False)
    p = normalize(path)
    for column, found in ((dirname(p), folder), (p, whole)):
        if found:
            out = out | F.concat(F.lit("/"), column).rlike("^(?:" + "|".join(dict.fromkeys(found)) + ")")
    return out


def py_excluded(path: str, entries: list[dict]) -> bool:
    """The same test for a plain string."""
    p = clean(path)
    folder = p.rpartition("/")[0]
    for e in entries:
        if e.get("type", "folder") == "file":
            if py_glob_matches(p, e["pattern"]):
                return True
            continue
        a, b = folder_regexes(e["pattern"])
        if any(re.match(x.replace(r"\z", r"\Z"), "/" + folder) for x in a) or any(re.match(x.replace(r"\z", r"\Z"), "/" + p) for x in b):
            return True
    return False
