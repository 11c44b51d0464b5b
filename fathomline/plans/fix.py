"""A fix: the rules that can mend are applied in a fixed order.

Each pass plans its changes as rows (path, new_text), deletions or moves, and
the driver commits them; the tree is read again when files came or went.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


from ..lex import comments, formatter, imports, units
from ..lex.languages import DEFAULT_EXTENSIONS, IMPORT_EXTENSIONS, extensions
from ..operators import imports as import_rules
from ..operators import rules as r
from ..operators.extract import rewritten
from ..sources import sinks, tree


def comment_rewrites(files: DataFrame, keep: list[str]) -> DataFrame:
    kept = tuple(keep)
    return rewritten(files, lambda p, t, e: comments.strip_comments(t, e, kept)[0], DEFAULT_EXTENSIONS)


def spacing_rewrites(files: DataFrame) -> DataFrame:
    return rewritten(files, lambda p, t, e: units.apply_edits(t, units.boundary_edits(t, e)), DEFAULT_EXTENSIONS)


def format_rewrites(files: DataFrame, width: int) -> DataFrame:
    return rewritten(files, lambda p, t, e: formatter.format_text(t, e, width), DEFAULT_EXTENSIONS)


def string_rewrites(files: DataFrame, width: int) -> DataFrame:
    return rewritten(files, lambda p, t, e: t if formatter.generated_source(p) else formatter.split_long_strings(t, e, width), extensions("script"))


def specifier_rewrites(files: DataFrame, edits: DataFrame) -> DataFrame:
    """edits: (path, start, end, replacement), applied from the end of each text."""
    @F.pandas_udf("string")
    def run(text: pd.Series, found: pd.Series) -> pd.Series:
        out = []
        for t, es in zip(text, found, strict=True):
            for e in sorted(es, key=lambda e: -e["start"]):
                t = t[: e["start"]] + e["replacement"] + t[e["end"] :]
            out.append(t)
        return pd.Series(out)

    per = edits.groupBy("path").agg(F.collect_list(F.struct("start", "end", "replacement")).alias("es"))
    return files.join(per, "path").select("path", run("text", "es").alias("new_text"))


def relative_specifier(source: str, target: str, like: str) -> str:
    """How source names target; with the extension or ``/index`` only if ``like`` has it."""
    import os

    spec = os.path.relpath(target, os.path.dirname(source) or ".").replace(os.sep, "/")
    spec = spec if spec.startswith(".") else "./" + spec
    stem, ext = os.path.splitext(spec)
    old = os.path.splitext(like)[1].lower()
    if not old:
        spec = stem
        if spec.endswith("/index") and not like.endswith("/index"):
            spec = spec[: -len("/index")]
    elif old in (".js", ".jsx", ".mjs", ".cjs") and ext.lower() != old:
        spec = stem + old
    return spec


def move_rewrites(files: DataFrame, moves: DataFrame) -> DataFrame:
    """Edits for every import whose file, or whose target, moves.  moves: (path, suggested_path)."""
    to = moves.select(F.col("path").alias("_p"), F.col("suggested_path").alias("_to"))
    edges = import_rules.import_edges(files, statements=True)
    both = edges.join(to.select(F.col("_p").alias("path"), F.col("_to").alias("new_source")), "path", "left").join(to.select(F.col("_p").alias("target"), F.col("_to").alias("new_target")), "target", "left")
    touched = both.filter(F.col("new_source").isNotNull() | F.col("new_target").isNotNull())
    name = F.udf(relative_specifier, "string")
    return touched.select("path", "start", "end", name(F.coalesce("new_source", "path"), F.coalesce("new_target", "target"), F.col("specifier")).alias("replacement"))


def alias_edits(files: DataFrame, aliases: DataFrame, allow_relative) -> DataFrame:
    """Relative imports whose target has an alias; allow_relative as in imports()."""
    edges = import_rules.import_edges(files, statements=True).withColumnRenamed("target", "resolved").filter(~import_rules.may_stay_relative(allow_relative))
    return edges.join(aliases.select("id", F.col("path").alias("resolved")), "resolved").select("path", "start", "end", F.col("id").alias("replacement"))


def removal_edits(files: DataFrame) -> DataFrame:
    """Whole-line removal of bare imports that resolve to nothing."""
    found = import_rules.resolve(import_rules.candidates(import_rules.specifiers(files, True)), files)
    lost = found.filter(F.col("resolved").isNull() & F.col("removal_start").isNotNull())
    return lost.select("path", F.col("removal_start").alias("start"), F.col("removal_end").alias("end"), F.lit("").alias("replacement"))


def without_dead_names(text: str, ext: str) -> str:
    """Import statements trimmed by the names that nothing uses."""
    import re

    dead = set(imports.imported_names(text)) - set(imports.used_identifiers(text))
    if not dead:
        return text

    def trim(m: re.Match) -> str:
        clause, rest = m.group("clause"), m.group("rest")
        kind = "type " if clause.startswith("type ") else ""
        clause = clause.removeprefix("type ").strip()
        head, brace, named = clause.partition("{")
        parts = []
        if (star := re.match(r"\*\s*as\s+(\S+)", clause)) is not None:
            parts = [] if star.group(1) in dead else [clause]
        else:
            if (d := head.rstrip(", ").strip()) and d not in dead:
                parts.append(d)
            left = [p.strip() for p in named.rstrip("} ").split(",") if p.split() and p.split()[-1] not in dead] if brace else []
            if left:
                parts.append("{ " + ", ".join(left) + " }")
        return f"import {kind}{', '.join(parts)} from {rest}" if parts else ""

    return re.sub(r"^[ \t]*import\s+(?P<clause>(?:type\s+)?[^\"';]+?)\s+from\s+(?P<rest>[\"'][^\"'\n]+[\"'];?[ \t]*\n?)", trim, text, flags=re.M)


def fix(spark: SparkSession, root: str, config: dict, aliases: DataFrame | None = None) -> dict[str, dict[str, int]]:
    """Apply the selected fixable rules to a tree; counters by rule."""
    ignore = tree.ignore_patterns(root) if config["use_gitignore"] else []
    done: dict[str, dict[str, int]] = {}

    def read():
        return tree.read_tree(spark, root, extensions=config["extensions"], exclude=config["exclude"], ignore=ignore)

    def write(rewrites: DataFrame) -> dict[str, int]:
        return sinks.commit(root, {row["path"]: row["new_text"] for row in rewrites.toLocalIterator()})

    for rule in config["selected"]:
        options = config["rules"][rule]
        files, dirs = read()
        mine = r.without_excluded(files, options["exclude_dirs"])
        if rule == "banned-files":
            hits = r.banned_files(files, options["patterns"], exclude_dirs=options["exclude_dirs"]).select("file_path").distinct()
            done[rule] = sinks.commit(root, deletes=[row[0] for row in hits.collect()])
        elif rule == "min-file-lines":
            done[rule] = _collapse(root, files, mine, options["min"])
        elif rule == "redundant-path-segments":
            moves = r.redundant_path_segments(files, options["separators"], exclude_dirs=options["exclude_dirs"]).select(F.col("file_path").alias("path"), "suggested_path")
            pairs = [(row[0], row[1]) for row in moves.orderBy("path").collect()]
            sinks.check_moves(root, pairs)
            edits = specifier_rewrites(files, move_rewrites(files, moves))
            done[rule] = sinks.commit(root, {row["path"]: row["new_text"] for row in edits.collect()}, moves=pairs)
        elif rule == "imports":
            edits = removal_edits(mine)
            if aliases is not None:
                edits = edits.unionByName(alias_edits(files, aliases, options["allow_relative"]))
            n = write(specifier_rewrites(mine, edits))
            if options["remove_dead_imports"]:
                fresh = r.without_excluded(read()[0], options["exclude_dirs"])
                n["rewritten"] += write(rewritten(fresh, lambda p, t, e: without_dead_names(t, e), extensions("script")))["rewritten"]
            done[rule] = n
        elif rule == "remove-comments":
            done[rule] = write(comment_rewrites(mine, options["exclude"]))
        elif rule == "structural-blank-lines":
            done[rule] = write(spacing_rewrites(mine))
        elif rule == "format":
            done[rule] = write(format_rewrites(mine, config["width"]))
        elif rule == "max-characters-per-line":
            done[rule] = write(string_rewrites(mine, options["max"]))
        elif rule == "remove-empty-folders":
            guard = [*config["exclude"], *options["exclude_dirs"]]
            done[rule] = {"deleted": sinks.remove_empty_folders(root, lambda p: tree.skip_folder(p, p.rpartition("/")[2], guard, ignore))}
    return done


def _collapse(root: str, files: DataFrame, mine: DataFrame, minimum: int) -> dict[str, int]:
    """Point importers of short redirect files at the end of the chain, then delete the files."""
    short = r.min_file_lines(mine, minimum).select(F.col("file_path").alias("path"))
    shims = import_rules.redirect_shims(files.filter(F.col("ext").isin(IMPORT_EXTENSIONS))).join(short, "path", "left_semi")
    to = shims.select(F.col("path").alias("target"), F.col("target").alias("final"))
    edges = import_rules.import_edges(files, statements=True).join(to, "target").join(shims.select("path"), "path", "left_anti")
    name = F.udf(relative_specifier, "string")
    edits = edges.select("path", "start", "end", name("path", "final", "specifier").alias("replacement"))
    gone = [row[0] for row in shims.select("path").orderBy("path").collect()]
    return sinks.commit(root, {row["path"]: row["new_text"] for row in specifier_rewrites(files, edits).collect()}, deletes=gone)


