"""Schemas of the relations, and the shape every rule's result has."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FILES = "path_abs string, path string, path_src string, ext string, byte_size long, text string"
DIRS = "path string, n_entries int"
VIOLATIONS = "rule string, fix boolean, file_path string, message string, details string, suggested_path string, severity string"
COMMENT_RANGES = "array<struct<start:int,end:int,kind:string>>"
FUNCTION_SPANS = "array<struct<kind:string,name:string,start_line:int,end_line:int,line_count:int,code_line_count:int>>"
DECLARATIONS = "array<struct<kind:string,name:string,line:int>>"
SPECIFIERS = "array<struct<specifier:string,start:int,end:int,removal_start:int,removal_end:int>>"
UNITS = "array<struct<scope:string,group:string,name:string,start_line:int,end_line:int>>"

#: The rules in the order their results are joined.
RULES = (
    "banned-patterns", "banned-files", "min-file-lines", "min-declaration-name", "max-declaration-name", "max-file-lines",
    "max-characters-per-line", "max-function-lines", "redundant-path-segments", "imports", "remove-comments", "dry",
    "structural-blank-lines", "remove-empty-folders", "format",
)
#: The rules that can mend what they find, in the order they are applied.
FIXABLE = (
    "banned-files", "min-file-lines", "redundant-path-segments", "imports", "remove-comments",
    "structural-blank-lines", "format", "max-characters-per-line", "remove-empty-folders",
)


def violations(df: DataFrame, rule: str, message: Column, details: dict[str, Column], *, fix: bool = False, path: Column | None = None,
               suggested: Column | None = None, severity: Column | None = None) -> DataFrame:
    """Rows of df as violations; details becomes JSON with its keys in the given order."""
    body = F.to_json(F.struct(*(c.alias(k) for k, c in details.items())), {"ignoreNullFields": "true"})
    none = F.lit(None).cast("string")
    return df.select(
        F.lit(rule).alias("rule"),
        F.lit(fix).alias("fix"),
        (F.col("path") if path is None else path).alias("file_path"),
        message.alias("message"),
        body.alias("details"),
        (none if suggested is None else suggested).alias("suggested_path"),
        (none if severity is None else severity).alias("severity"),
    )
