"""A check: every selected rule as one plan, joined, given severities and ordered."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import imports as import_rules
from ..operators import rules as r
from ..operators.extract import with_features
from ..schema import RULES

_NEEDS = {
    "banned-patterns": ("module_specifiers",), "min-file-lines": ("masked_text",), "max-file-lines": ("masked_text",), "min-declaration-name": ("declarations",), "max-declaration-name": ("declarations",),
    "max-function-lines": ("function_spans",), "imports": ("module_specifiers", "imported_names", "used_identifiers"), "remove-comments": ("comment_ranges",), "structural-blank-lines": ("boundary_edits",), "dry": ("dry_descriptors",),
}


def lexed(files: DataFrame, selected: list[str]) -> DataFrame:
    """Files with every feature the rules need, lexed in one pass."""
    return with_features(files, *(f for rule in selected for f in _NEEDS.get(rule, ())))


def rule_violations(rule: str, options: dict, files: DataFrame, dirs: DataFrame | None, aliases: DataFrame | None, width: int) -> DataFrame | None:
    ex = options["exclude_dirs"]
    if rule == "remove-empty-folders":
        return r.remove_empty_folders(dirs, exclude_dirs=ex) if dirs is not None else None
    plans = {
        "banned-patterns": lambda: r.banned_patterns(files, options["patterns"], exclude_dirs=ex),
        "banned-files": lambda: r.banned_files(files, options["patterns"], exclude_dirs=ex),
        "min-file-lines": lambda: r.min_file_lines(files, options["min"], exclude_dirs=ex),
        "max-file-lines": lambda: r.max_file_lines(files, options["max"], exclude_dirs=ex),
        "min-declaration-name": lambda: r.declaration_names(files, minimum=options["min"], exclude_dirs=ex),
        "max-declaration-name": lambda: r.declaration_names(files, maximum=options["max"], exclude_dirs=ex),
        "max-characters-per-line": lambda: r.max_characters_per_line(files, options["max"], exclude_dirs=ex),
        "max-function-lines": lambda: r.max_function_lines(files, options["max"], exclude_dirs=ex),
        "redundant-path-segments": lambda: r.redundant_path_segments(files, options["separators"], exclude_dirs=ex),
        "imports": lambda: import_rules.imports(files, aliases, allow_relative=options["allow_relative"], remove_dead=options["remove_dead_imports"], exclude_dirs=ex),
        "remove-comments": lambda: r.remove_comments(files, options["exclude"], exclude_dirs=ex),
        "structural-blank-lines": lambda: r.structural_blank_lines(files, exclude_dirs=ex),
        "dry": lambda: r.dry(files, options["min_duplicate_characters"], exclude_dirs=ex),
        "format": lambda: r.format_files(files, width, exclude_dirs=ex),
    }
    return plans[rule]()


def with_severity(df: DataFrame, configured: str) -> DataFrame:
    """A row's own severity beats the rule's; failures carry none."""
    own = F.coalesce("severity", F.lit(configured))
    return df.withColumn("severity", F.when(own == "warning", F.lit("warning")))


def check(config: dict, files: DataFrame, dirs: DataFrame | None = None, aliases: DataFrame | None = None, *, already_lexed: bool = False) -> DataFrame:
    """All violations of a normalised config, with the rule's place as rule_order."""
    shared = files if already_lexed else lexed(files, config["selected"])
    out = None
    for rule in config["selected"]:
        options = config["rules"][rule]
        found = rule_violations(rule, options, shared, dirs, aliases, config["width"])
        if found is None:
            continue
        one = with_severity(found, options["severity"]).withColumn("rule_order", F.lit(RULES.index(rule)))
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no rule is selected")
    return out


def ordered(violations: DataFrame) -> DataFrame:
    """By path and rule as people sort them; equal ones by the order of the rules."""
    return violations.orderBy(F.collate("file_path", "UNICODE"), F.collate("rule", "UNICODE"), "rule_order", "message")


def blocking(severity: str = "severity"):
    return F.coalesce(F.col(severity), F.lit("fail")) != "warning"


def summary(violations: DataFrame) -> DataFrame:
    """One row: ok, violation_count, blocking_count, rules."""
    n = F.count_if(blocking())
    return violations.agg((n == 0).alias("ok"), F.count("*").alias("violation_count"), n.alias("blocking_count"), F.array_join(F.array_sort(F.collect_set("rule")), ",").alias("rules"))


def by_rule(violations: DataFrame) -> DataFrame:
    return violations.groupBy("rule").agg(F.count("*").alias("n"), F.countDistinct("file_path").alias("files"), F.count_if(blocking()).alias("blocking"))


def top_files(violations: DataFrame, n: int) -> DataFrame:
    """The n files of every rule with most violations; least path first among equals."""
    from pyspark.sql import Window

    counted = violations.groupBy("rule", "file_path").agg(F.count("*").alias("n"))
    order = Window.partitionBy("rule").orderBy(F.desc("n"), "file_path")
    return counted.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= n)
