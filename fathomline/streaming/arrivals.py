"""Checking files as they arrive: an extension, one check per micro-batch.

Rules are per batch: those that compare files see the files of one batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.query import StreamingQuery

from ..plans.check import check


def check_arrivals(spark: SparkSession, path: str, schema: str, to_files: Callable[[DataFrame], DataFrame], config: dict, out: str, checkpoint: str) -> StreamingQuery:
    """Read Parquet files that land in path, and append their violations to out.

    The batch number is part of what is written, so a batch that is run again
    after a failure replaces its own rows.
    """

    def one(batch: DataFrame, number: int) -> None:
        check(config, to_files(batch)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    source = spark.readStream.schema(schema).parquet(path)
    return source.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
