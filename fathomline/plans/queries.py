"""Named queries: the rules and their parts over the standard tables, with SQL.

Each query reads whole tables.  Documents stand for text files, page addresses
for paths, and parts for small script files made from a template.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import config as cfg
from ..functions import paths, texts
from ..operators import imports as imp
from ..operators import rules as r
from ..operators import similar
from ..operators.extract import exploded, with_features
from ..sources.table import from_table
from . import check as plans

_COLUMNS = ["rule", "fix", "file_path", "message", "details", "suggested_path", "severity"]
PATTERNS = [{"value": "License", "allowed_files": []}, {"value": "anea", "allowed_files": ["src1/1.txt", "src7/99.txt"]}, {"value": "!!", "allowed_files": []}, {"value": "reserved.", "allowed_files": []}]
GLOBS = ["**/*.html", "*/en/9*", "*.example.org/**", "blog.*/??/*"]
EXCLUDED = [{"type": "folder", "pattern": "fr"}, {"type": "folder", "pattern": "blog.*"}, {"type": "file", "pattern": "**/*.html"}, {"type": "folder", "pattern": "spam-farm.example.org/en"}]
MAX_WIDTH, MAX_LINES, MIN_LINES = 150, 20, 2


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files <source>/<id>.txt, which no lexer reads."""
    d = table(spark, sf_dir, "documents")
    path = F.concat_ws("/", "source", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return r.without_specifiers(from_table(d, path, F.col("text"), F.lit(".txt")))


def page_path() -> Column:
    """An address without scheme, query and fragment."""
    return F.regexp_replace(F.regexp_replace("url", "^https?://", ""), r"[?#].*$", "")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select("page_id", page_path().alias("path"))
    return p.select("page_id", F.col("path").alias("path_abs"), "path", F.col("path").alias("path_src"), paths.extension(F.col("path")).alias("ext"))


def _name() -> Column:
    return F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_"), F.col("p_size").cast("string"))


def scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part as a script of one import, one comment and one function.

    Which imported names are used, how many lines lie between, and whether the
    import leads anywhere hang on the part's columns.
    """
    one, two = F.concat(F.lit("n_"), F.substring_index("p_name", " ", 1)), F.concat(F.lit("k_"), F.lower("p_type"))
    text = F.concat(
        F.lit("import { "), one, F.lit(", "), two, F.lit(", total } from './"), (F.col("p_partkey") + F.col("p_size")).cast("string"), F.lit("'; // from "), "p_brand",
        F.repeat(F.lit("\n"), F.col("p_size") % 4 + 1), F.lit("export function "), _name(), F.lit("(alpha, beta) {\n  const text = \"// "), "p_name", F.lit("\";\n  /* size */\n\n  return alpha + beta + text + "),
        F.col("p_size").cast("string"), F.when(F.col("p_size") % 2 == 0, F.concat(F.lit(" + "), one)).otherwise(""), F.when(F.col("p_size") % 3 == 0, " + total").otherwise(""), F.lit(";\n}\n"),
    )
    p = table(spark, sf_dir, "part")
    return from_table(p, F.concat(F.lit("parts/"), F.col("p_partkey").cast("string"), F.lit(".ts")), text, F.lit(".ts"))


#: A module of every language: extension, signs around a short and a long comment, header, statement (before, literal, after), last statement, end, what follows.
MODULES = [
    (".ts", ("// ", ""), ("/* ", " */"), "export function NAME(alpha, beta) {", ("  total(alpha, ", '"// not"', ");"), "  return beta;", "}", "  const LIMIT = 5;"),
    (".go", ("// ", ""), ("/* ", " */"), "func NAME(alpha int, beta int) int {", ("  total(alpha, ", '"// not"', ")"), "  return beta", "}", "const (\n  LIMIT = 5\n)"),
    (".rs", ("// ", ""), ("/* ", " */"), "pub fn NAME(alpha: i32, beta: i32) -> i32 {", ("  total(alpha, ", '"/* not"', ");"), "  return beta;", "}", "const LIMIT: i32 = 5;"),
    (".cpp", ("// ", ""), ("/* ", " */"), "int NAME(int alpha, int beta) {", ("  total(alpha, ", '"// not"', ");"), "  return beta;", "}", "using LIMIT = int;"),
    (".cs", ("// ", ""), ("/* ", " */"), "public static int NAME(int alpha, int beta) {", ("  Total(alpha, ", '@"// not"', ");"), "  return beta;", "}", "namespace LIMIT;"),
    (".py", ("# ", ""), None, "ASYNC def NAME(alpha, beta):", ("  total(alpha, ", "'# not'", ")"), "  return beta", None, "LIMIT = 5"),
    (".sh", ("# ", ""), None, "NAME() {", ("  total ", '"# not"', ""), "  echo beta", "}", "LIMIT=5"),
    (".qml", ("// ", ""), ("/* ", " */"), "function NAME(alpha, beta) {", ("  total(alpha, ", "'// not'", ");"), "  return beta;", "}", "property int LIMIT: 5"),
    (".css", ("/* ", " */"), ("/* ", " */"), ".NAME {", ("  content: ", '"/* not"', ";"), "  margin: 0;", "}", ":root { --LIMIT: 5; }"),
    (".scss", ("// ", ""), ("/* ", " */"), "@mixin NAME {", ("  content: ", '"// not"', ";"), "  margin: 0;", "}", "$LIMIT: 5;"),
]


def modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part as a source file, in ten languages by turns.

    The numbers of comments, statements and blank lines hang on its columns.
    """
    size, line = F.col("p_size"), lambda *parts: F.concat(*(F.lit(x) if isinstance(x, str) else x for x in parts), F.lit("\n"))

    def text(ext, short, long, header, literal, last, end, after) -> Column:
        block = line("  ", long[0], "part\n  ", F.col("p_type"), long[1]) if long else line("  ", short[0], F.col("p_type"))
        named = F.replace(F.replace(F.lit(header), F.lit("NAME"), _name()), F.lit("ASYNC "), F.when(size % 2 == 1, "async ").otherwise(""))
        return F.concat(
            F.repeat(line(short[0], "note of ", F.col("p_brand"), short[1]), size % 4), F.repeat(F.lit("\n"), (F.floor(F.col("p_partkey") / 10) % 3).cast("int")), line(named),
            F.repeat(line("".join(literal)), size % 5), F.repeat(block, F.length("p_type") % 3), F.repeat(F.lit("\n"), size % 2),
            F.lit(last), F.when(size % 3 == 0, f" {short[0]}end{short[1]}").otherwise(""), F.lit("\n" + (end + "\n" if end else "") + "\n"), line(after),
        )

    turn = F.col("p_partkey") % len(MODULES)
    pick = lambda f: F.coalesce(*(F.when(turn == i, f(m)) for i, m in enumerate(MODULES)))
    ext = pick(lambda m: F.lit(m[0]))
    p = table(spark, sf_dir, "part")
    return from_table(p, F.concat(F.lit("modules/"), F.col("p_partkey").cast("string"), ext), pick(lambda m: text(*m)), ext)


def _out(df: DataFrame) -> DataFrame:
    return df.select(*_COLUMNS)


def long_lines(spark, sf_dir):
    return _out(r.max_characters_per_line(documents(spark, sf_dir), MAX_WIDTH))


def file_line_limits(spark, sf_dir):
    d = documents(spark, sf_dir)
    return _out(r.max_file_lines(d, MAX_LINES).unionByName(r.min_file_lines(d, MIN_LINES)))


def banned_patterns(spark, sf_dir):
    return _out(r.banned_patterns(documents(spark, sf_dir), PATTERNS))


def banned_paths(spark, sf_dir):
    return _out(r.banned_files(pages(spark, sf_dir), GLOBS))


def excluded_paths(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", "path", paths.excluded(F.col("path"), EXCLUDED).alias("excluded"))


def path_redundancy(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    folder = F.when(F.col("p_size") % 3 == 0, F.substring_index("p_name", " ", 1)).when(F.col("p_size") % 3 == 1, F.concat(F.substring_index("p_name", " ", -1), F.lit("s"))).otherwise(F.lower(F.replace("p_brand", F.lit("#"), F.lit(""))))
    path = F.concat(F.lit("catalog/"), folder, F.lit("/"), _name_of("p_name"), F.lit(".ts"))
    files = p.select(path.alias("path"), path.alias("path_src"), F.lit(".ts").alias("ext"))
    return _out(r.redundant_path_segments(files, ["_"]))


def _name_of(c: str) -> Column:
    return F.replace(c, F.lit(" "), F.lit("_"))


def path_scalars(spark, sf_dir):
    p = F.col("path")
    ext = paths.extension(p)
    return pages(spark, sf_dir).select(
        "page_id", paths.normalize(F.concat(F.lit("./"), F.replace(p, F.lit("/"), F.lit("//")))).alias("normal"), paths.dirname(p).alias("dir"), paths.basename(p).alias("base"), ext.alias("ext"),
        paths.without_extension(paths.basename(p), ext).alias("stem"), paths.dotted(p).alias("dotted"), paths.slug(p).alias("slug"), paths.short_sha1(p).alias("sha1"),
        paths.singular(paths.basename(paths.dirname(p))).alias("token"), paths.valid_alias(F.concat(F.lit("#"), p)).alias("valid"),
    )


def alias_ids(spark, sf_dir):
    return imp.alias_ids(pages(spark, sf_dir).select("path").distinct())


def text_scalars(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    t = F.col("text")
    return c.select("conv_id", "turn", F.length(t).alias("chars"), texts.physical_lines(t).alias("physical"), texts.code_lines(t).alias("full_lines"), F.size(texts.text_lines(t)).alias("lines"), F.size(texts.trigrams(t)).alias("grams"), texts.fnv1a(t).alias("fnv"))


def _squeezed(d: DataFrame) -> DataFrame:
    t = F.regexp_replace(F.lower("text"), r"\s+", "")
    return d.select("path", F.lit("text").alias("name"), F.lit("text").alias("language"), F.lit("standalone").alias("classification"), F.lit(1).alias("start_line"), F.length(t).alias("character_count"), t.alias("fingerprint"))


def dup_groups(spark, sf_dir):
    return _out(r.duplicate_groups(_squeezed(documents(spark, sf_dir))))


def _turns(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "conversations").filter("text IS NOT NULL").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("role").alias("language"), "text")


def near_dup_pairs(spark, sf_dir):
    return similar.exact_pairs(_turns(spark, sf_dir), 0.55).select("a", "b", "common", "whole")


def near_dup_components(spark, sf_dir):
    return similar.groups(similar.exact_links(_turns(spark, sf_dir), 0.55))


def near_dup_bands(spark, sf_dir):
    return similar.band_pairs(_turns(spark, sf_dir), 0.3)


def _links(spark, sf_dir) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    host = F.regexp_extract("url", "^https?://([^/]+)", 1)
    return p.select("page_id", host.alias("host"), F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("href"))


def link_unresolved(spark, sf_dir):
    """Links of a page that no page of the table is the target of."""
    known = pages(spark, sf_dir).select(F.col("path").alias("target")).distinct()
    target = F.when(F.startswith("href", F.lit("/")), F.concat("host", "href")).otherwise(F.regexp_replace(F.regexp_replace("href", "^https?://", ""), r"[?#].*$", ""))
    return _links(spark, sf_dir).withColumn("target", target).join(known, "target", "left_anti").groupBy("page_id", "target").agg(F.count("*").alias("n"))


def path_resolution(spark, sf_dir):
    """Every address resolved to the first of its simpler forms that is a known path."""
    u = table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", "^https?://", "").alias("raw"))
    known = pages(spark, sf_dir).filter(~F.endswith("path", F.lit("/"))).select("path")
    forms = F.array(F.col("raw"), F.regexp_replace("raw", "#.*$", ""), F.regexp_replace("raw", r"[?#].*$", ""), F.regexp_replace(F.regexp_replace("raw", r"[?#].*$", ""), "/$", ""), F.concat(F.regexp_replace(F.regexp_replace("raw", r"[?#].*$", ""), "/$", ""), F.lit(".html")))
    ranked = u.select("page_id", "raw", F.posexplode(forms).alias("rank", "candidate"))
    return imp.resolve(ranked, known)


def dead_names(spark, sf_dir):
    return imp.dead_names(scripts(spark, sf_dir))


def unresolved_imports(spark, sf_dir):
    return _out(imp.imports(scripts(spark, sf_dir), remove_dead=True))


def comment_counts(spark, sf_dir):
    return _out(r.remove_comments(modules(spark, sf_dir)))


def function_spans(spark, sf_dir):
    return exploded(modules(spark, sf_dir), "function_spans").select("path", "kind", "name", "start_line", "end_line", "line_count", "code_line_count")


def function_limits(spark, sf_dir):
    return _out(r.max_function_lines(modules(spark, sf_dir), 5))


def declaration_names(spark, sf_dir):
    m = modules(spark, sf_dir)
    return _out(r.declaration_names(m, maximum=12).unionByName(r.declaration_names(m, minimum=11)))


def script_duplicates(spark, sf_dir):
    return _out(r.dry(scripts(spark, sf_dir)))


def script_spacing(spark, sf_dir):
    return _out(r.structural_blank_lines(scripts(spark, sf_dir)))


def stripped_modules(spark, sf_dir):
    from .fix import comment_rewrites

    return comment_rewrites(modules(spark, sf_dir), [])


def formatted_scripts(spark, sf_dir):
    from .fix import format_rewrites

    return format_rewrites(scripts(spark, sf_dir), 60)


def formatted_modules(spark, sf_dir):
    from .fix import format_rewrites

    return format_rewrites(modules(spark, sf_dir), 80)


def module_line_limits(spark, sf_dir):
    """Lines of code, comments aside, against both limits."""
    m = modules(spark, sf_dir)
    return _out(r.max_file_lines(m, 8).unionByName(r.min_file_lines(m, 5)))


def masked_modules(spark, sf_dir):
    """Modules with their comments, then also their literals, as blanks."""
    return with_features(modules(spark, sf_dir), "masked_text", "masked_literals").select("path", "masked_text", "masked_literals")


def blank_runs(spark, sf_dir):
    """Gaps of blank lines between neighbouring full lines of a document."""
    full = texts.lines(documents(spark, sf_dir)).filter(F.col("line_text").rlike(r"\S"))
    order = Window.partitionBy("path").orderBy("line")
    gaps = full.withColumn("prior", F.lag("line").over(order)).filter(F.col("prior").isNotNull())
    return gaps.groupBy("path").agg(F.count("*").alias("boundaries"), F.sum(F.col("line") - F.col("prior") - 1).alias("blank_lines"), F.sum(F.when(F.col("line") - F.col("prior") == 2, 1).otherwise(0)).alias("single"))


def prefix_line_counts(spark, sf_dir):
    """Running number of full lines, as a range count of lines needs it."""
    order = Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    full = F.sum(F.when(F.col("line_text").rlike(r"\S"), 1).otherwise(0)).over(order)
    return texts.lines(documents(spark, sf_dir)).select("path", "line", full.alias("full_lines"))


CONFIG = {"rules": {
    "max-characters-per-line": {"max": MAX_WIDTH}, "max-file-lines": {"max": MAX_LINES}, "min-file-lines": {"min": MIN_LINES, "severity": "warning"},
    "banned-patterns": {"patterns": PATTERNS}, "banned-files": {"patterns": ["src1/*"], "severity": "warning"},
}}


def violations_union(spark, sf_dir):
    return plans.check(cfg.normalize(CONFIG), documents(spark, sf_dir), already_lexed=True).select(*_COLUMNS, "rule_order")


def violations_summary(spark, sf_dir):
    return plans.summary(violations_union(spark, sf_dir))


def violations_by_rule(spark, sf_dir):
    return plans.by_rule(violations_union(spark, sf_dir))


def rule_file_topn(spark, sf_dir):
    return plans.top_files(violations_union(spark, sf_dir), 5)


def blocking_paths(spark, sf_dir):
    """Files with a violation that is no warning, less those one rule already covers."""
    v = violations_union(spark, sf_dir)
    fixed = v.filter("rule = 'banned-patterns'").select("file_path").distinct()
    return v.filter(plans.blocking()).select("file_path").distinct().join(fixed, "file_path", "left_anti")


QUERIES = {f.__name__: f for f in (
    long_lines, file_line_limits, banned_patterns, banned_paths, excluded_paths, path_redundancy, path_scalars, alias_ids, text_scalars, dup_groups, near_dup_pairs, near_dup_components, near_dup_bands, link_unresolved,
    path_resolution, dead_names, unresolved_imports, comment_counts, function_spans, function_limits, declaration_names, script_duplicates, script_spacing, stripped_modules, formatted_scripts, formatted_modules, masked_modules, module_line_limits,
    blank_runs, prefix_line_counts, violations_union, violations_summary, violations_by_rule, rule_file_topn, blocking_paths,
)}
