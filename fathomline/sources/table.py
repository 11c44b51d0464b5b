"""Any table with a text column as files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths


def from_table(df: DataFrame, path: Column, text: Column, ext: Column | None = None) -> DataFrame:
    """Rows as files; without ext it is taken from the path.  Null texts are left out."""
    p = paths.normalize(path.cast("string"))
    rows = df.select(p.alias("path_abs"), p.alias("path"), p.alias("path_src"), (paths.extension(p) if ext is None else ext).alias("ext"), text.cast("string").alias("text"))
    return rows.filter(F.col("text").isNotNull()).select("path_abs", "path", "path_src", "ext", F.octet_length("text").cast("long").alias("byte_size"), "text")
