"""A source tree as a table: the ``sourcetree`` data source and its helpers.

Spark's own file source passes over names that begin with a dot or underscore
and over empty folders, which rules about trees need.
"""

from __future__ import annotations

import os
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.paths import clean, py_excluded, py_glob_matches
from ..lex.languages import DEFAULT_EXTENSIONS

# fixed values: folders never entered, by name or by path
ALWAYS_EXCLUDED = (".git", "node_modules", "dist", ".vite")
STATE_EXCLUDED = (".fathomline/generated", ".fathomline/imports", ".fathomline/reports")
SCHEMA = "kind string, path_abs string, path string, path_src string, ext string, byte_size long, n_entries int, text string"


def skip_folder(path: str, name: str, exclude: list[dict], ignore: list[str]) -> bool:
    """Whether a folder is left out: by name, by folder pattern, or by an ignore pattern."""
    if name in ALWAYS_EXCLUDED or path in STATE_EXCLUDED:
        return True
    for e in exclude:
        if e.get("type", "folder") == "file":
            continue
        p = clean(e["pattern"]).rstrip("/")
        if py_glob_matches(name, p) or py_glob_matches(path, p) or path == p or path.startswith(p + "/"):
            return True
    for raw in ignore:
        p = clean(raw).strip("/")
        if not p:
            continue
        if "/" not in p and (py_glob_matches(name, p) or py_glob_matches(path, "**/" + p)):
            return True
        if py_glob_matches(path, p) or py_glob_matches(path, p + "/**"):
            return True
    return False


class _Folders(InputPartition):
    def __init__(self, folders: list[str]):
        self.folders = folders


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        import json

        self.root = os.path.abspath(options["path"])
        self.exts = set(json.loads(options.get("extensions", "null")) or DEFAULT_EXTENSIONS)
        self.exclude = json.loads(options.get("exclude", "[]"))
        self.ignore = json.loads(options.get("ignore", "[]"))
        self.batch = int(options.get("foldersperpartition", 64))
        self.text = options.get("text", "true") == "true"

    def partitions(self):
        """Folders in batches; a skipped folder is not entered."""
        found, todo = [], [""]
        while todo:
            folder = todo.pop()
            found.append(folder)
            for e in os.scandir(os.path.join(self.root, folder)):
                if e.is_dir(follow_symlinks=False):
                    path = f"{folder}/{e.name}" if folder else e.name
                    if not skip_folder(path, e.name, self.exclude, self.ignore):
                        todo.append(path)
        found.sort()
        return [_Folders(found[i : i + self.batch]) for i in range(0, len(found), self.batch)]

    def read(self, partition):
        files_only = [e for e in self.exclude if e.get("type", "folder") == "file"]
        for folder in partition.folders:
            entries = sorted(os.scandir(os.path.join(self.root, folder)), key=lambda e: e.name)
            rows = [("dir", os.path.join(self.root, folder), folder, folder, "", 0, len(entries), None)]
            for e in entries:
                if not e.is_file(follow_symlinks=False):
                    continue
                ext = os.path.splitext(e.name)[1].lower()
                path = f"{folder}/{e.name}" if folder else e.name
                if ext not in self.exts or py_excluded(path, files_only):
                    continue
                text = None
                if self.text:
                    try:
                        text = Path(e.path).read_bytes().decode()
                    except (OSError, UnicodeDecodeError):
                        continue
                rows.append(("file", e.path, path, path, ext, e.stat().st_size, 0, text))
            kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in SCHEMA.split(", ")])


class SourceTree(DataSource):
    """``spark.read.format("sourcetree").load(root)``; options as JSON: extensions, exclude, ignore."""

    @classmethod
    def name(cls):
        return "sourcetree"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(dict(self.options))


def read_tree(spark: SparkSession, root: str, *, extensions=None, exclude=None, ignore=None) -> tuple[DataFrame, DataFrame]:
    """(files, dirs) of a tree; unreadable and non-UTF-8 files are left out."""
    import json

    spark.dataSource.register(SourceTree)
    df = spark.read.format("sourcetree").options(extensions=json.dumps(list(extensions) if extensions else None), exclude=json.dumps(exclude or []), ignore=json.dumps(ignore or [])).load(root)
    files = df.filter("kind = 'file'").select("path_abs", "path", "path_src", "ext", "byte_size", "text")
    return files, df.filter("kind = 'dir'").select("path", "n_entries")


def scan_metrics(files: DataFrame, dirs: DataFrame) -> dict[str, int]:
    """Folders entered, files kept, and their bytes."""
    from pyspark.sql import functions as F

    n = files.agg(F.count("*").alias("files"), F.coalesce(F.sum("byte_size"), F.lit(0)).alias("bytes")).first()
    return {"directories": dirs.count(), "files": n["files"], "bytes": n["bytes"]}


def _ignore_lines(path: Path) -> list[str]:
    try:
        lines = path.read_text().splitlines()
    except OSError:
        return []
    return [s for line in lines if (s := line.strip()) and not s.startswith(("#", "!"))]


def ignored_folders(root: str, path: str | None = None) -> list[str]:
    """Plain folder names of the root's ignore file."""
    out = []
    for s in _ignore_lines(Path(path or os.path.join(root, ".gitignore"))):
        name = s.strip("/")
        if not name or any(c in name for c in "*?[]"):
            continue
        if s.endswith("/") or os.path.isdir(os.path.join(root, name)) or name.startswith(".") or "." not in name:
            out.append(name)
    return list(dict.fromkeys(out))


def ignore_patterns(root: str, path: str | None = None) -> list[str]:
    """Its lines as globs; negated ones are passed over."""
    return list(dict.fromkeys(s.strip("/") for s in _ignore_lines(Path(path or os.path.join(root, ".gitignore")))))
