"""Mixing sources to target weights: Poisson replication with a hash-seeded draw."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_names, input_bytes

#: Numbers in the distribution functions sent to every worker, at most (8 bytes each); more are joined by shuffle.
MOST_BROADCAST = 1 << 20


def uniform(*key: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of the md5 of the joined keys."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *key)), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def rates(docs: DataFrame, source_col: str, weights: dict[str, float] | None, temperature: float, epochs: float) -> DataFrame:
    """(source, rate, cdf): the mean repetitions of a source's documents.

    The expected output is epochs times the input, shared out by weight.  cdf
    holds the Poisson distribution function up to where it is 1 for doubles.
    """
    counts = docs.groupBy(F.col(source_col).alias("source")).agg(F.count("*").alias("n"))
    if weights is None:
        weight = F.pow(F.col("n").cast("double"), F.lit(float(temperature)))
    else:
        given = F.create_map(*(F.lit(x) for k, v in weights.items() for x in (k, float(v)))) if weights else F.create_map().cast("map<string,double>")
        weight = F.coalesce(F.try_element_at(given, F.col("source").cast("string")), F.lit(0.0))
    weighed = counts.withColumn("w", weight)
    total, sum_w = weighed.agg(F.sum("n"), F.sum("w")).first()
    rate = F.lit(float(epochs)) * F.lit(total or 0) * F.col("w") / F.lit(sum_w) / F.col("n") if sum_w else F.lit(0.0)
    mean = weighed.select("source", rate.alias("rate"))
    last = F.ceil(F.col("rate") + 12 * F.sqrt("rate") + 30).cast("int")

    def step(acc: Column, k: Column) -> Column:
        log_fact = acc["log_fact"] + F.when(k > 0, F.log(k.cast("double"))).otherwise(F.lit(0.0))
        mass = F.exp(F.when(k > 0, k * F.log("rate")).otherwise(F.lit(0.0)) - F.col("rate") - log_fact)
        total = acc["total"] + mass
        return F.struct(log_fact.alias("log_fact"), total.alias("total"), F.concat(acc["cdf"], F.array(total)).alias("cdf"))

    start = F.struct(F.lit(0.0).alias("log_fact"), F.lit(0.0).alias("total"), F.array().cast("array<double>").alias("cdf"))
    cdf = F.aggregate(F.sequence(F.lit(0), last), start, step, lambda acc: acc["cdf"])
    return mean.select("source", "rate", F.when(F.col("rate") > 0, cdf).otherwise(F.array(F.lit(1.0))).alias("cdf"))


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: dict[str, float] | None = None,
        temperature: float = 0.5, epochs: float = 1.0, seed: int = 29) -> DataFrame:
    """Repeat every document a Poisson number of times and shuffle all copies.

    Without weights a source's target weight is its number of documents to the
    power of temperature (1 keeps the proportions, 0 makes sources equal); with
    weights, sources not named get none.  A null source is a source.  The draw
    hangs on the id and the seed alone, so it is the same on every run; rows of
    equal id share their number of copies, and rows without id draw by text.

    Returns the columns of docs with copy_no (from 0) and shuffle_key, in the
    order of the key over all partitions; columns of those names are replaced.
    An empty table gives no rows.
    """
    docs = docs.drop(*({"copy_no", "shuffle_key"} & set(docs.columns)))
    spread = rates(docs, source_col, weights, temperature, epochs)
    held = spread.agg(F.sum(F.size("cdf") + 8)).first()[0] or 0
    by, cdf, draw, copies = free_names(docs, "_source", "_cdf", "_draw", "_copies")
    spread = spread.select(F.coalesce(F.col("source").cast("string"), F.lit("\x00")).alias(by), F.col("cdf").alias(cdf))
    side = F.broadcast(spread) if held <= MOST_BROADCAST else spread
    name = F.coalesce(F.col(id_col).cast("string"), F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")))
    drawn = docs.withColumn(by, F.coalesce(F.col(source_col).cast("string"), F.lit("\x00"))).join(side, by)
    times = F.size(F.filter(F.col(cdf), lambda c: c <= F.col(draw)))
    each = drawn.withColumn(draw, uniform(F.lit(str(seed)), F.lit("copies"), name)).withColumn(copies, times).filter(F.col(copies) > 0)
    key = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit("order"), name, F.col("copy_no").cast("string"))), 1, 15), 16, 10).cast("long")
    many = each.withColumn("copy_no", F.explode(F.sequence(F.lit(0), F.col(copies) - 1))).withColumn("shuffle_key", key)
    parts = max(1, min(1 << 20, -(-input_bytes(docs) // (16 << 20))))
    order = ["shuffle_key", id_col, "copy_no"]
    return many.repartitionByRange(parts, *order).sortWithinPartitions(*order).select(*docs.columns, "copy_no", "shuffle_key")


def oracle_sql(table: str = "documents", temperature: float = 0.5, epochs: float = 1.0, seed: int = 29) -> str:
    """DuckDB SQL for (doc_id, source, copy_no, shuffle_key) of mix() without weights."""
    return f"""
WITH counts AS (SELECT source, count(*) AS n FROM {table} GROUP BY source),
weighed AS (SELECT *, pow(n::DOUBLE, {temperature}) AS w FROM counts),
mean AS (SELECT source, {epochs}::DOUBLE * (SELECT sum(n) FROM weighed) * w / (SELECT sum(w) FROM weighed) / n AS rate FROM weighed),
steps AS (SELECT source, rate, unnest(range(0, ceil(rate + 12 * sqrt(rate) + 30)::BIGINT + 1)) AS k FROM mean),
cdf AS (SELECT source, k, sum(exp(CASE WHEN k > 0 THEN k * ln(rate) ELSE 0 END - rate - lgamma(k + 1)))
          OVER (PARTITION BY source ORDER BY k ROWS UNBOUNDED PRECEDING) AS c FROM steps),
lists AS (SELECT source, list(c ORDER BY k) AS cs FROM cdf GROUP BY source),
named AS (SELECT doc_id, source, coalesce(doc_id::VARCHAR, md5(coalesce(text, ''))) AS name FROM {table}),
drawn AS (SELECT doc_id, d.source, name, len(list_filter(cs, lambda c: c <= ('0x' || substr(md5('{seed}:copies:' || name), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE)) AS copies
          FROM named d JOIN lists l ON d.source IS NOT DISTINCT FROM l.source),
many AS (SELECT doc_id, source, name, unnest(range(0, copies)) AS copy_no FROM drawn)
SELECT doc_id, source, copy_no::INTEGER AS copy_no, ('0x' || substr(md5('{seed}:order:' || name || ':' || copy_no), 1, 15))::BIGINT AS shuffle_key FROM many
"""
