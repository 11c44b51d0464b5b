"""Import hygiene: relative specifiers, what they resolve to, and names never used.

Resolution is an equi-join: a specifier explodes into its ranked candidate
paths, and the first that is a file of the inventory wins.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from ..lex.languages import DEFAULT_EXTENSIONS, IMPORT_EXTENSIONS, extensions
from ..schema import violations
from .extract import exploded, with_features
from .rules import without_excluded


def specifiers(files: DataFrame, statements: bool = False) -> DataFrame:
    """(path, ext, ordinal, specifier, start, end, removal_start, removal_end), by lines as check reads them or by statements as fix does."""
    return exploded(files.filter(F.col("ext").isin(IMPORT_EXTENSIONS)), "statement_specifiers" if statements else "module_specifiers")


def candidates(found: DataFrame, source_extensions: list[str] | None = None) -> DataFrame:
    """Relative specifiers with one row per candidate path and its rank; none if they leave the root."""
    exts = F.array(*map(F.lit, source_extensions or DEFAULT_EXTENSIONS))
    relative = found.filter(F.startswith("specifier", F.lit("./")) | F.startswith("specifier", F.lit("../")))
    segments = F.filter(F.split(F.concat(paths.dirname(F.col("path")), F.lit("/"), F.col("specifier")), "/"), lambda s: ~s.isin("", "."))
    root = F.array().cast("array<string>")

    def step(walked, s):
        """Null once a step has left the root."""
        up = F.when(F.size(walked) > 0, F.slice(walked, 1, F.size(walked) - 1))
        return F.when(s == "..", up).otherwise(F.concat(walked, F.array(s)))

    rows = relative.withColumn("_at", F.aggregate(segments, root, step)).withColumn("_base", F.array_join("_at", "/"))
    base, below = F.col("_base"), F.when(F.col("_base") == "", "").otherwise(F.concat("_base", F.lit("/")))
    above = F.array_join(F.slice("_at", 1, F.greatest(F.size("_at") - 1, F.lit(0))), "/")
    partial = F.concat(F.when(above == "", "").otherwise(F.concat(above, F.lit("/"))), F.lit("_"), F.coalesce(F.try_element_at("_at", F.lit(-1)), F.lit("")), F.lit(".scss"))
    styles = F.array(F.concat(base, F.lit(".scss")), partial, F.concat(below, F.lit("index.scss")), F.concat(below, F.lit("_index.scss")))
    stem = F.regexp_replace(base, r"(?i)\.(?:js|jsx|mjs|cjs)$", "")
    scripts = F.concat(
        F.array(base), F.when(stem != base, F.transform(exts, lambda e: F.concat(stem, e))).otherwise(root),
        F.transform(exts, lambda e: F.concat(base, e)), F.transform(exts, lambda e: F.concat(below, F.lit("index"), e)),
    )
    listed = F.when(F.col("_at").isNotNull(), F.when(F.col("ext").isin(extensions("scss")), styles).otherwise(scripts))
    return rows.withColumn("_c", listed).select(*found.columns, F.posexplode_outer("_c").alias("rank", "candidate"))


def may_stay_relative(allowed: list[str] | Callable[[str, dict], bool] | None) -> Column:
    """Whether a resolved specifier may stay relative: by prefixes, or by a function of the specifier and its context.

    The context names source_file and resolved_file; the function sees batches of rows in the workers.
    """
    if callable(allowed):
        decide = F.udf(lambda specifier, source, target: bool(allowed(specifier, {"source_file": source, "resolved_file": target})), "boolean", useArrow=True)
        return decide("specifier", "path", "resolved")
    out = F.lit(False)
    for prefix in ["./"] if allowed is None else allowed:
        out = out | F.startswith("specifier", F.lit(prefix))
    return out


def resolve(ranked: DataFrame, inventory: DataFrame) -> DataFrame:
    """Every (path, ordinal) with the first candidate that exists; null resolves nowhere.

    inventory: path.  The first match is a combined minimum, not a sort.
    """
    known = inventory.select(F.col("path").alias("candidate")).distinct().withColumn("_known", F.lit(True))
    keys = [c for c in ranked.columns if c not in ("rank", "candidate")]
    hit = F.min(F.when(F.col("_known"), F.struct("rank", "candidate")))
    return ranked.join(known, "candidate", "left").groupBy(*keys).agg(hit.alias("_hit")).select(*keys, F.col("_hit.candidate").alias("resolved"))


def import_edges(files: DataFrame, source_extensions: list[str] | None = None, statements: bool = False) -> DataFrame:
    """(path, target) of every relative import that resolves."""
    return resolve(candidates(specifiers(files, statements), source_extensions), files).filter("resolved IS NOT NULL").select("path", F.col("resolved").alias("target"), "specifier", "start", "end")


def imports(files: DataFrame, aliases: DataFrame | None = None, *, allow_relative: list[str] | Callable[[str, dict], bool] | None = None, remove_dead: bool = False, source_extensions=None, exclude_dirs=None) -> DataFrame:
    """Unresolved imports, relative imports that have an alias, and names never used.

    aliases: (id, path).  allow_relative: prefixes that may stay relative, or a
    function of a specifier and its context.
    """
    mine = without_excluded(files, exclude_dirs)
    found = resolve(candidates(specifiers(mine), source_extensions), files)
    lost = found.filter(F.col("resolved").isNull())
    message = F.concat(F.lit("unresolved import "), "specifier", F.lit(" should be removed"))
    removable = violations(lost.filter(F.col("removal_start").isNotNull()), "imports", message, {"specifier": F.col("specifier")}, fix=True)
    out = violations(lost.filter(F.col("removal_start").isNull()), "imports", message, {"specifier": F.col("specifier")}).unionByName(removable)
    if aliases is not None:
        named = found.filter(F.col("resolved").isNotNull()).filter(~may_stay_relative(allow_relative)).join(aliases.select("id", F.col("path").alias("resolved")), "resolved")
        message = F.concat(F.lit("relative import "), "specifier", F.lit(" should be rewritten to "), "id")
        out = out.unionByName(violations(named, "imports", message, {"specifier": F.col("specifier"), "aliasId": F.col("id"), "resolvedFile": F.col("resolved")}, fix=True))
    if remove_dead:
        dead = dead_names(mine)
        out = out.unionByName(violations(dead, "imports", F.concat(F.lit("unused import "), "name", F.lit(" should be removed")), {"name": F.col("name")}, fix=True))
    return out


def dead_names(files: DataFrame) -> DataFrame:
    """(path, name) bound by an import and not used outside imports."""
    scripts = with_features(files.filter(F.col("ext").isin(extensions("script"))), "imported_names", "used_identifiers")
    unused = F.array_except("imported_names", "used_identifiers")
    return scripts.select("path", F.explode(unused).alias("name"))


def uncovered_roots(aliases: DataFrame, include_roots: list[str]) -> DataFrame:
    """First segments of alias targets that no include root covers."""
    first = F.substring_index(paths.normalize(F.col("path")), "/", 1)
    return aliases.select(first.alias("root")).distinct().filter(~F.col("root").isin(include_roots))


def alias_ids(inventory: DataFrame, strategy: str = "relative-path-slug", prefix: str = "#") -> DataFrame:
    """(id, path) by a strategy that hangs on the path alone; equal ids get a running number."""
    from pyspark.sql import Window

    stem = paths.without_extension(F.col("path"), paths.extension(F.col("path")))
    name = paths.short_sha1(F.col("path")) if strategy == "relative-path-hash" else paths.slug(stem)
    rows = inventory.select("path", F.concat(F.lit(prefix), name).alias("base"))
    same = Window.partitionBy("base").orderBy("path")
    n = F.row_number().over(same)
    return rows.withColumn("n", n).select(F.when(F.col("n") == 1, F.col("base")).otherwise(F.concat("base", F.lit("-"), F.col("n"))).alias("id"), "path")


def redirect_shims(files: DataFrame, source_extensions=None) -> DataFrame:
    """(path, target): files that only forward to one other file, with the end of their chain.

    A shim is a single ``export ... from`` statement, or one ``@forward``.
    Chains are followed by joining until no target is a shim; a circle keeps
    no target.
    """
    body = F.regexp_replace(F.col("text"), r"(?m)^[ \t]*//.*$", "")
    one = body.rlike(r"\A\s*export\s+(type\s+)?(\*(\s+as\s+\w+)?|\{[^}]*\})\s+from\s+[\"'][^\"']+[\"'];?\s*\z") | (body.rlike(r"\A\s*@forward\s+[\"'][^\"']+[\"'];?\s*\z") & (F.col("ext") == ".scss"))
    shims = files.filter(one)
    edges = resolve(candidates(specifiers(shims), source_extensions), files).filter("resolved IS NOT NULL").groupBy("path").agg(F.min("resolved").alias("target"))
    hops = edges
    for _ in range(20):
        onward = hops.join(edges.select(F.col("path").alias("target"), F.col("target").alias("next")), "target", "left")
        hops = onward.select("path", F.coalesce("next", "target").alias("target"))
        if hops.join(edges.select(F.col("path").alias("target")), "target", "left_semi").isEmpty():
            break
    return hops.join(edges.select(F.col("path").alias("target")), "target", "left_anti").select("path", "target")
