"""Languages by extension, and what each of them supports."""

from __future__ import annotations

# fixed values: the extensions that are scanned unless the config says otherwise
FAMILIES = {
    "script": (".ts", ".tsx", ".js", ".jsx", ".mjs", ".mts", ".cts", ".cjs"), "go": (".go",), "rust": (".rs",),
    "cpp": (".cpp", ".cc", ".cxx", ".c++", ".hpp", ".hh", ".hxx", ".h++", ".h"), "csharp": (".cs",), "python": (".py",),
    "shell": (".sh", ".bash", ".zsh"), "qml": (".qml",), "scss": (".scss",), "css": (".css",),
}
DEFAULT_EXTENSIONS = tuple(e for family in FAMILIES.values() for e in family)
_BY_EXT = {e: name for name, family in FAMILIES.items() for e in family}
STYLES = ("scss", "css")


def language(ext: str) -> str:
    """The family of an extension; the empty string for any other."""
    return _BY_EXT.get(ext, "")


def extensions(*families: str) -> list[str]:
    return [e for f in families for e in FAMILIES[f]]


IMPORT_EXTENSIONS = extensions("script", "scss")
FUNCTION_EXTENSIONS = [e for e in DEFAULT_EXTENSIONS if _BY_EXT[e] not in STYLES]
