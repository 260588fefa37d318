"""Incremental collection with Structured Streaming: cursors, de-duplication, idempotent upserts.

Offsets live in the checkpoint, so a cursor never runs ahead of the rows it stands for: a batch whose write fails is
read again. ``foreachBatch`` writes are keyed by batch number, so that a repeated batch replaces itself.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vacantia.tables import checkpoint_dir


def stream_of(spark: SparkSession, path: str) -> DataFrame:
    """A parquet file or folder as a stream; its schema is read once, never inferred in flight."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    return spark.readStream.schema(schema).option("pathGlobFilter", name).option("maxFilesPerTrigger", 100).parquet(folder)


def run_once(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Processes all that is there and stops; a later call goes on from the checkpoint."""
    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def _landed(spark: SparkSession, stream: DataFrame, watermark: str | None = None) -> DataFrame:
    """The rows of a finished stream, landed in the shared folder batch by batch."""
    base = f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/rows/batch={number}")

    run_once(stream, write, f"{base}/checkpoint")
    return spark.read.schema(stream.schema).parquet(f"{base}/rows")


def read_since(spark: SparkSession, path: str, column: str, cursor: int) -> DataFrame:
    """The rows beyond a cursor, collected as a stream."""
    return _landed(spark, stream_of(spark, path).filter(F.col(column) > cursor))


def bounded_catch_up(rows: DataFrame, column: str, cursor: int, limit: int, factor: int = 5) -> DataFrame:
    """Batch form: at most ``factor`` times ``limit`` rows beyond the cursor, the oldest first."""
    return rows.filter(F.col(column) > cursor).orderBy(column).limit(factor * limit)


def next_messages(rows: DataFrame, column: str, cursor: int | None, limit: int, factor: int = 5) -> DataFrame:
    """What a run reads, in ascending order: at first the latest ``limit`` rows, later the oldest beyond the cursor, at most
    ``factor`` times as many. ``safe_limit_reached`` tells that there may be more; it is false at first."""
    if cursor is None:
        return rows.orderBy(F.desc(column)).limit(limit).orderBy(column).withColumn("safe_limit_reached", F.lit(False))
    batch = bounded_catch_up(rows, column, cursor, limit, factor)
    return batch.orderBy(column).withColumn("safe_limit_reached", F.lit(batch.count() >= factor * limit))


def emitted(seen: DataFrame | None, poll: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows to emit, keys seen afterwards) of a poll: the first one only primes, later ones emit what is new, once."""
    keys = poll.select(*key).distinct()
    if seen is None:
        return poll.limit(0), keys
    return poll.dropDuplicates(key).join(seen, key, "left_anti"), seen.unionByName(keys).distinct()


def deduplicated(spark: SparkSession, path: str, key: list[str], within: str = "7 days", time: str = "ts") -> DataFrame:
    """The first row of each key within a time. A key is held until the watermark is ``within`` past its first row, so the
    state is as large as the keys of that span. NTZ times are cast first."""
    stream = stream_of(spark, path).withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, within)
    return _landed(spark, stream.dropDuplicatesWithinWatermark(key))


def advance_cursor(state: DataFrame, batch: DataFrame, key: str, column: str) -> DataFrame:
    """The cursors after a batch; they never go back."""
    new = batch.groupBy(key).agg(F.max(column).alias("cursor"))
    return state.unionByName(new).groupBy(key).agg(F.max("cursor").alias("cursor"))


def upsert_batch(path: str, key: list[str], order: str | None = None) -> Callable[[DataFrame, int], None]:
    """A writer for ``foreachBatch``: appends versions of records by batch number; ``current`` reads the latest ones. Of a
    key's rows in one batch the one of the highest ``order`` counts; without an order a batch must hold each key once."""

    def write(batch: DataFrame, number: int) -> None:
        if order is None:
            n = F.count("*").over(Window.partitionBy(*key))
            ok = F.when(F.col("__n") == 1, True).otherwise(F.raise_error(F.lit("a key occurs twice in a batch without order")).cast("boolean"))
            latest = batch.withColumn("__n", n).filter(ok).drop("__n")
        else:
            rank = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(order)))
            latest = batch.withColumn("__rank", rank).filter("__rank = 1").drop("__rank")
        latest.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def upserted(spark: SparkSession, path: str, key: list[str], order: str) -> DataFrame:
    """The latest record of each key of a stream, written batch by batch and read back."""
    base = f"{checkpoint_dir(spark)}/upsert-{uuid.uuid4().hex}"
    run_once(stream_of(spark, path), upsert_batch(f"{base}/rows", key, order), f"{base}/checkpoint")
    return current(spark, f"{base}/rows", key)


def current(spark: SparkSession, path: str, key: list[str]) -> DataFrame:
    rows = spark.read.parquet(path)
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("batch")))
    return rows.withColumn("__rank", rank).filter("__rank = 1").drop("__rank", "batch")
