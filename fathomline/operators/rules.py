"""The rules: each takes files and its options and returns violations.

Rules over lines, counts and paths are plain column expressions; the others
read features of the lexer layer, which callers may have added already.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths, texts
from ..lex.languages import DEFAULT_EXTENSIONS, FUNCTION_EXTENSIONS, IMPORT_EXTENSIONS, extensions
from ..schema import violations
from .extract import exploded, rewritten, with_features

STATE_DIR = ".fathomline"


def without_excluded(files: DataFrame, exclude_dirs: list[dict] | None) -> DataFrame:
    return files.filter(~paths.excluded(F.col("path"), exclude_dirs)) if exclude_dirs else files


def searchable_text(files: DataFrame, state_dir: str = STATE_DIR) -> Column:
    """Text in small letters without module specifiers and paths of the state folder."""
    text = F.lower("text")
    if "module_specifiers" in files.columns:
        taken = F.filter(F.transform("module_specifiers", lambda s: F.lower(s["specifier"])), lambda s: s != "")
        text = F.aggregate(taken, text, lambda t, s: F.replace(t, s, F.lit("")))
    return F.regexp_replace(text, texts.java_quote(state_dir.lower()) + "[A-Za-z0-9._/-]*", "")


def banned_patterns(files: DataFrame, patterns: list[dict], *, exclude_dirs=None, state_dir: str = STATE_DIR, fold: bool = False) -> DataFrame:
    """One row per file and pattern found in it; overlapping occurrences count.

    With fold, strings that scripts put together are searched as well.

    patterns: {value, allowed_files}.  They are tested side by side in one
    projection, so the files are read once and nothing is multiplied out.
    """
    files = without_excluded(files, exclude_dirs)
    if "module_specifiers" not in files.columns and "_plain" not in files.columns:
        files = _script_specifiers(files)
    if fold:
        files = with_features(files, "folded_strings")
    parts = F.transform("folded_strings", lambda x: F.lower(x)) if fold else F.array().cast("array<string>")
    searched = files.select("path", searchable_text(files, state_dir).alias("_t"), parts.alias("_folded"))

    def one(p: dict) -> Column:
        allowed = p.get("allowed_files") or []
        n = texts.overlapping_count(F.col("_t"), p["value"].lower())
        if allowed:
            n = F.when(F.col("path").isin(allowed), F.lit(0)).otherwise(n)
        files_ = F.array(*(F.lit(a) for a in allowed)).cast("array<string>")
        put = F.filter("_folded", lambda x: F.contains(x, F.lit(p["value"].lower()))) if not allowed else F.when(~F.col("path").isin(allowed), F.filter("_folded", lambda x: F.contains(x, F.lit(p["value"].lower())))).otherwise(F.array().cast("array<string>"))
        return F.struct(F.lit(p["value"]).alias("pattern"), (n + F.size(put)).alias("n"), F.size(put).alias("folded"), put.alias("matches"), files_.alias("allowed"))

    hits = searched.select("path", F.inline(F.filter(F.array(*map(one, patterns)), lambda h: h["n"] > 0)))
    message = F.concat(F.lit('file contains banned pattern "'), "pattern", F.lit('"'), F.when(F.col("n") > 1, F.concat(F.lit(" "), F.col("n"), F.lit(" times"))).otherwise(F.lit("")))
    details = {"pattern": F.col("pattern"), "occurrences": F.col("n"), "foldedOccurrences": F.col("folded"), "foldedMatches": F.col("matches"), "allowedFiles": F.col("allowed")}
    return violations(hits, "banned-patterns", message, details)


def _script_specifiers(files: DataFrame) -> DataFrame:
    """Specifiers only where there can be some, so that other texts stay out of Python."""
    marked = files.select("path", "ext", "text")
    yes = with_features(marked.filter(F.col("ext").isin(IMPORT_EXTENSIONS)), "module_specifiers")
    no = marked.filter(~F.coalesce(F.col("ext"), F.lit("")).isin(IMPORT_EXTENSIONS))
    return yes.unionByName(no.withColumn("module_specifiers", F.array().cast(yes.schema["module_specifiers"].dataType)))


def without_specifiers(files: DataFrame) -> DataFrame:
    """Files of no known language, for which the lexer layer is left out."""
    return files.withColumn("_plain", F.lit(True))


def banned_files(files: DataFrame, globs: list[str], *, exclude_dirs=None) -> DataFrame:
    """One row per file and glob that its path matches; the text is not read."""
    files = without_excluded(files, exclude_dirs)
    tests = [F.when(paths.glob_matches(F.col("path"), g), F.lit(g)) for g in dict.fromkeys(globs)]
    hits = files.select("path", F.explode(F.array_compact(F.array(*tests))).alias("glob"))
    return violations(hits, "banned-files", F.format_string('file path matches banned glob "%s"', "glob"), {"glob": F.col("glob")}, fix=True)


def _code_lines(files: DataFrame) -> tuple[DataFrame, Column]:
    if "_plain" in files.columns:
        return files, texts.code_lines(F.col("text"))
    files = with_features(files, "masked_text")
    return files, texts.code_lines(F.col("masked_text"))


def min_file_lines(files: DataFrame, minimum: int = 1, *, exclude_dirs=None) -> DataFrame:
    files, code = _code_lines(without_excluded(files, exclude_dirs))
    hits = files.select("path", code.alias("n")).filter(F.col("n") <= minimum)
    message = F.concat(F.lit("file has "), F.col("n"), F.lit(" "), texts.plural(F.col("n"), "line", "lines"), F.lit(f" and is at or below the banned minimum of {minimum}"))
    return violations(hits, "min-file-lines", message, {"lineCount": F.col("n"), "min": F.lit(minimum)})


def max_file_lines(files: DataFrame, maximum: int, *, exclude_dirs=None) -> DataFrame:
    """Code lines over the limit fail; if only the physical lines are over it, a warning."""
    files, code = _code_lines(without_excluded(files, exclude_dirs))
    n = files.select("path", code.alias("code"), texts.physical_lines(F.col("text")).alias("n"))
    over = F.col("code") > maximum
    hits = n.filter(over | (F.col("n") > maximum))
    message = F.when(over, F.concat(F.lit("file has "), F.col("code"), F.lit(f" lines and exceeds the limit of {maximum}"))).otherwise(
        F.concat(F.lit("file has "), F.col("n"), F.lit(" physical lines, but only "), F.col("code"), F.lit(f" code lines count toward the limit of {maximum}"))
    )
    details = {"lineCount": F.when(over, F.col("code")).otherwise(F.col("n")), "codeLineCount": F.when(~over, F.col("code")), "max": F.lit(maximum)}
    return violations(hits, "max-file-lines", message, details, severity=F.when(~over, F.lit("warning")))


def max_characters_per_line(files: DataFrame, maximum: int = 150, *, exclude_dirs=None) -> DataFrame:
    """Lines over the limit, in code points; scripts' inline SVG and .svg files are passed over."""
    files = without_excluded(files, exclude_dirs).filter(F.coalesce(F.col("ext"), F.lit("")) != ".svg")
    script = F.coalesce(F.col("ext"), F.lit("")).isin(extensions("script"))
    long_ = F.length("line_text") > maximum
    rows = texts.lines(files.filter(~script)).filter(long_)
    # the depth of a sum that never falls below 0 is the sum less its least value so far
    marked = texts.lines(files.filter(script & F.contains("text", F.lit("<svg"))))
    step = F.regexp_count("line_text", F.lit("<svg")) - F.regexp_count("line_text", F.lit("</svg"))
    order = Window.partitionBy("path").orderBy("line")
    sofar = order.rowsBetween(Window.unboundedPreceding, 0)
    depth = marked.withColumn("s", F.sum(step).over(sofar)).withColumn("depth", F.col("s") - F.least(F.lit(0), F.min("s").over(sofar)))
    before = F.coalesce(F.lag("depth").over(order), F.lit(0))
    inside = (before > 0) | (F.regexp_count("line_text", F.lit("<svg")) > 0)
    kept = depth.withColumn("inside", inside).filter(~F.col("inside") & long_).select("path", "line", "line_text")
    simple = texts.lines(files.filter(script & ~F.contains("text", F.lit("<svg")))).filter(long_)
    hits = rows.unionByName(simple).unionByName(kept).select("path", "line", F.length("line_text").alias("n"))
    message = F.concat(F.lit("line "), F.col("line"), F.lit(" has "), F.col("n"), F.lit(f" characters and exceeds the limit of {maximum}"))
    return violations(hits, "max-characters-per-line", message, {"line": F.col("line"), "characterCount": F.col("n"), "max": F.lit(maximum)})


def max_function_lines(files: DataFrame, maximum: int, *, exclude_dirs=None) -> DataFrame:
    files = without_excluded(files, exclude_dirs).filter(F.col("ext").isin(FUNCTION_EXTENSIONS))
    spans = exploded(files, "function_spans")
    over = F.col("code_line_count") > maximum
    hits = spans.filter(over | (F.col("line_count") > maximum))
    head = F.concat("kind", F.lit(" "), "name", F.lit(" has "))
    message = F.when(over, F.concat(head, F.col("code_line_count"), F.lit(f" lines and exceeds the limit of {maximum}"))).otherwise(
        F.concat(head, F.col("line_count"), F.lit(" physical lines, but only "), F.col("code_line_count"), F.lit(f" code lines count toward the limit of {maximum}"))
    )
    details = {
        "functionKind": F.col("kind"), "functionName": F.col("name"), "lineCount": F.when(over, F.col("code_line_count")).otherwise(F.col("line_count")),
        "codeLineCount": F.when(~over, F.col("code_line_count")), "max": F.lit(maximum), "startLine": F.col("start_line"), "endLine": F.col("end_line"),
    }
    return violations(hits, "max-function-lines", message, details, severity=F.when(~over, F.lit("warning")))


def declaration_names(files: DataFrame, *, minimum: int | None = None, maximum: int | None = None, exclude_dirs=None) -> DataFrame:
    """Names shorter than the minimum or longer than the maximum, whichever is given."""
    files = without_excluded(files, exclude_dirs)
    named = exploded(files, "declarations").withColumn("length", F.length(F.regexp_replace("name", r"^(?:--|[$%])", "")))
    if minimum is not None:
        hits, rule, words, bound = named.filter(F.col("length") < minimum), "min-declaration-name", "below the minimum name length of", {"min": F.lit(minimum)}
    else:
        hits, rule, words, bound = named.filter(F.col("length") > maximum), "max-declaration-name", "exceeds the maximum name length of", {"max": F.lit(maximum)}
    message = F.concat("kind", F.lit(" "), "name", F.lit(" has "), F.col("length"), F.lit(" "), texts.plural(F.col("length"), "character", "characters"), F.lit(f" and {words} {minimum if minimum is not None else maximum}"))
    details = {"declarationKind": F.col("kind"), "declarationName": F.col("name"), "line": F.col("line"), "length": F.col("length"), **bound}
    return violations(hits, rule, message, details)


def redundant_path_segments(files: DataFrame, separators: list[str] | None = None, *, exclude_dirs=None, any_extension: bool = False) -> DataFrame:
    """File names that repeat their folder, or could share one.

    In order: the part after the last separator names a folder on the way; the
    part before the first separator is the folder's name; or several files of
    the folder share that part.
    """
    seps = [s for s in (separators or ["_", "-"]) if s]
    files = without_excluded(files, exclude_dirs)
    if not any_extension:
        files = files.filter(F.col("ext").isin(list(DEFAULT_EXTENSIONS)))
    base = paths.without_extension(paths.basename(F.col("path_src")), F.col("ext"))
    rows = files.select("path", "ext", base.alias("base"), paths.dirname(F.col("path_src")).alias("dir"))
    # what is used several times below is worked out once, behind an explode that keeps it apart
    folders = F.filter(F.split("dir", "/"), lambda s: ~s.isin("", "."))
    named_folders = F.transform(folders, lambda s: F.struct(paths.singular(s).alias("token"), s.alias("name")))
    rows = rows.select("path", "ext", "base", "dir", F.explode(F.array(named_folders)).alias("folders"))

    def cut(sep: str, last: bool) -> Column:
        """(index, prefix, remainder, separator) at the first or last separator; null if either side is empty."""
        at = F.when(F.instr("base", sep) > 0, F.length("base") - F.length(F.substring_index("base", sep, -1)) - len(sep) if last else F.length(F.substring_index("base", sep, 1)))
        prefix, rest = F.left("base", at), F.substring("base", at + 1 + len(sep), F.length("base"))
        return F.when((at > 0) & (rest != ""), F.struct(at.alias("at"), prefix.alias("prefix"), rest.alias("remainder"), F.lit(sep).alias("separator")))

    def best(found: list[Column], last: bool) -> Column:
        """Of several separators the outermost; the one named first among equals."""
        ranked = F.array_compact(F.array(*(F.when(c.isNotNull(), F.struct((-c["at"] if last else c["at"]).alias("key"), F.lit(i).alias("i"), c.alias("c"))) for i, c in enumerate(found))))
        return F.array_min(ranked)["c"]

    def named(c: Column) -> Column:
        token = paths.singular(c["remainder"])
        hit = F.filter("folders", lambda f: f["token"] == token)
        return F.when(c.isNotNull() & (token != "") & (F.size(hit) > 0), c)

    both = F.struct(best([named(cut(s, True)) for s in seps], True).alias("tail"), best([cut(s, False) for s in seps], False).alias("head"))
    tails = rows.select("path", "ext", "dir", "folders", F.explode(F.array(both)).alias("m")).select("path", "ext", "dir", "folders", "m.tail", "m.head")
    group = Window.partitionBy("dir", F.col("head.prefix"))
    counted = tails.filter(F.col("tail").isNotNull() | F.col("head").isNotNull()).withColumn("n", F.when(F.col("head").isNotNull(), F.count("head").over(group)))
    folder = paths.dirname(F.col("path"))
    mode = (
        F.when(F.col("tail").isNotNull(), F.lit("redundant-path-segment"))
        .when(paths.basename(folder) == F.col("head.prefix"), F.lit("repeated-folder-prefix"))
        .when(F.col("n") >= 2, F.lit("same-directory-group"))
    )
    hits = counted.withColumn("mode", mode).filter(F.col("mode").isNotNull())
    by_tail = F.col("mode") == "redundant-path-segment"
    chosen = F.when(by_tail, F.col("tail")).otherwise(F.col("head"))
    name = F.concat(F.when(by_tail, F.col("tail.prefix")).otherwise(F.col("head.remainder")), F.col("ext"))
    under = F.when(F.col("mode") == "same-directory-group", paths.join(folder, F.col("head.prefix"))).otherwise(folder)
    target = paths.join(under, name)
    segment = F.when(by_tail, F.filter("folders", lambda f: f["token"] == paths.singular(F.col("tail.remainder")))[0]["name"])
    details = {"mode": F.col("mode"), "prefix": chosen["prefix"], "remainder": chosen["remainder"], "separator": chosen["separator"], "pathSegment": segment}
    return violations(hits, "redundant-path-segments", F.concat(F.lit("file path should be normalized to "), target), details, fix=True, suggested=target)


def remove_empty_folders(dirs: DataFrame, *, exclude_dirs=None) -> DataFrame:
    """Folders without any entry; the root is never one."""
    dirs = without_excluded(dirs, exclude_dirs)
    return violations(dirs.filter((F.col("n_entries") == 0) & (F.col("path") != "")), "remove-empty-folders", F.lit("empty folder should be removed"), {"path": F.col("path")}, fix=True)


def _without(ranges: Column, words: str) -> Column:
    """Ranges whose text does not hold the words."""
    return F.filter(ranges, lambda r: ~F.contains(F.substring(F.col("text"), r["start"] + 1, r["end"] - r["start"]), F.lit(words)))


def remove_comments(files: DataFrame, keep: list[str] | None = None, *, exclude_dirs=None) -> DataFrame:
    files = with_features(without_excluded(files, exclude_dirs).filter(F.col("ext").isin(list(DEFAULT_EXTENSIONS))), "comment_ranges")
    ranges = F.col("comment_ranges")
    for k in keep or []:
        if k:
            ranges = _without(ranges, k)
    kinds = lambda k: F.size(F.filter(ranges, lambda r: r["kind"] == k))
    hits = files.select("path", kinds("line").alias("a"), kinds("block").alias("b")).withColumn("n", F.col("a") + F.col("b")).filter(F.col("n") > 0)
    message = F.concat(F.lit("file contains "), F.col("n"), F.lit(" removable "), texts.plural(F.col("n"), "comment", "comments"))
    return violations(hits, "remove-comments", message, {"commentCount": F.col("n"), "lineComments": F.col("a"), "blockComments": F.col("b")}, fix=True)


def structural_blank_lines(files: DataFrame, *, exclude_dirs=None) -> DataFrame:
    """Neighbouring units of a scope that are not exactly one blank line apart."""
    files = without_excluded(files, exclude_dirs).filter(F.col("ext").isin(list(DEFAULT_EXTENSIONS)))
    hits = boundary_edits(files).groupBy("path").agg(F.count("*").alias("n"), F.sum("insert_count").alias("inserted"), F.sum("remove_count").alias("removed"))
    message = F.concat(F.lit("file has "), F.col("n"), F.lit(" structural "), texts.plural(F.col("n"), "boundary", "boundaries"), F.lit(" with incorrect blank line spacing"))
    details = {"boundaryCount": F.col("n"), "insertedBlankLines": F.col("inserted"), "removedBlankLines": F.col("removed")}
    return violations(hits, "structural-blank-lines", message, details, fix=True)


def boundary_edits(files: DataFrame) -> DataFrame:
    """(path, at_line, remove_count, insert_count): what brings the gaps between units to one blank line."""
    return exploded(files, "boundary_edits").select("path", "at_line", "remove_count", "insert_count")


def dry(files: DataFrame, min_duplicate_characters: int = 0, *, exclude_dirs=None) -> DataFrame:
    """Functions of one language whose normal forms are equal, one row per group."""
    files = without_excluded(files, exclude_dirs).filter(F.col("ext").isin(FUNCTION_EXTENSIONS))
    return duplicate_groups(exploded(files, "dry_descriptors"), min_duplicate_characters)


def duplicate_groups(descriptors: DataFrame, min_characters: int = 0) -> DataFrame:
    """descriptors: path, name, language, classification, start_line, character_count, fingerprint.

    Members are combined per fingerprint; a fingerprint of any length is
    grouped by its digest, so only digests are shuffled.
    """
    from ..lex.dry import LEAST_CHARACTERS

    floor = F.greatest(F.lit(min_characters), F.when(F.col("language") == "shell", 0).otherwise(LEAST_CHARACTERS))
    member = F.struct("path", "start_line", "name", "classification", "language")
    digest = F.sha2("fingerprint", 256)
    big = descriptors.filter(F.col("character_count") >= floor).groupBy(digest.alias("digest")).agg(F.sort_array(F.collect_list(member)).alias("g")).filter(F.size("g") > 1)
    functions = F.transform("g", lambda m: F.struct(m["classification"].alias("classification"), m["path"].alias("filePath"), m["language"].alias("language"), m["start_line"].alias("line"), m["name"].alias("name"), F.lit(False).alias("topLevel")))
    details = {
        "confidence": F.lit(1), "files": F.array_sort(F.array_distinct(F.transform("g", lambda m: m["path"]))), "fixable": F.lit(False), "functions": functions,
        "locations": F.transform("g", lambda m: F.concat(m["path"], F.lit("#"), m["name"])), "reason": F.lit("duplicate function group requires human canonicalization"), "signals": F.array(F.lit("exact-normalized")),
    }
    return violations(big, "dry", F.lit("duplicate function group"), details, path=F.lit("multiple files"))


def format_files(files: DataFrame, width: int = 100, *, exclude_dirs=None) -> DataFrame:
    from ..lex.formatter import format_text

    files = without_excluded(files, exclude_dirs).filter(F.col("ext").isin(list(DEFAULT_EXTENSIONS)))
    hits = rewritten(files, lambda path, text, ext: format_text(text, ext, width), DEFAULT_EXTENSIONS)
    return violations(hits, "format", F.lit("needs formatting"), {"formatter": F.lit("builtin"), "backend": F.lit("builtin")}, fix=True)
