"""Streaming twins of the temporal reducers and of run detection, over series that arrive layer by layer."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from terrella.errors import StorageError
from terrella.operators.reductions import exact

LAYERS = "ts timestamp, row int, col int, value {}, valid boolean"


def layers(spark: SparkSession, path: str, *, kind: str = "bigint", files_per_trigger: int = 16) -> DataFrame:
    """A stream of (ts, row, col, value, valid) from Parquet files as they arrive."""
    return spark.readStream.schema(LAYERS.format(kind)).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def reduced(stream: DataFrame, *, dtype: str = "int64") -> DataFrame:
    """Per cell: n, total, mean, low, high and std of all layers so far. The order of layers does not matter."""
    v = F.when(F.col("valid"), F.col("value"))
    total = F.sum(exact(v, dtype))
    return stream.groupBy("row", "col").agg(
        F.count(v).alias("n"), total.cast("double" if dtype.startswith("float") else "bigint").alias("total"), F.try_divide(total.cast("double"), F.count(v).cast("double")).alias("mean"),
        F.min(v).alias("low"), F.max(v).alias("high"), F.stddev_pop(v.cast("double")).alias("std"),
    )


def windowed(stream: DataFrame, *, width: str = "1 day", lateness: str = "1 hour") -> DataFrame:
    """Per cell and tumbling window: n and mean, closed when the watermark passes; later layers are dropped."""
    v = F.when(F.col("valid"), F.col("value"))
    return stream.withWatermark("ts", lateness).groupBy(F.window("ts", width), "row", "col").agg(F.count(v).alias("n"), F.avg(v).alias("mean")).select(F.col("window.start").alias("start"), "row", "col", "n", "mean")


def longest_runs(samples: DataFrame, *, step_hours: float) -> DataFrame:
    """Per cell: hours of the longest run of `cond` so far, from a stream of (ts, row, col, cond) in rising time across batches.

    State is three numbers a cell: the last time, the run that is open and the longest one. A sample that is not later than what was
    seen is an error, as in the batch writer.
    """

    def step(key: tuple, groups: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, run, best = state.get if state.exists else (0, 0, 0)
        rows = pd.concat(list(groups)).sort_values("ts")
        for ts, cond in zip(rows["ts"].astype("int64"), rows["cond"], strict=True):
            if ts <= last:
                raise ValueError("layers must arrive in strictly rising order")
            last, run = int(ts), run + 1 if cond else 0
            best = max(best, run)
        state.update((last, run, best))
        yield pd.DataFrame({"row": [key[0]], "col": [key[1]], "hours": [best * step_hours]})

    return samples.groupBy("row", "col").applyInPandasWithState(step, "row int, col int, hours double", "last long, run long, best long", "update", GroupStateTimeout.NoTimeout)


def run_to_table(result: DataFrame, path: str, checkpoint: str, *, mode: str = "complete"):
    """Process what is there and stop; each micro-batch replaces the table at `path` (complete) or appends to it. Restarts go on from the checkpoint."""

    def write(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(path)

    query = result.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    return query


def ordered_sink(path: str):
    """A foreachBatch function that appends layers by time and refuses times that were committed before."""

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        from terrella.sources.rasters import exists

        if exists(spark, path):
            last = spark.read.parquet(path).agg(F.max("ts")).first()[0]
            if last is not None and batch.filter(F.col("ts") <= F.lit(last)).limit(1).count():
                raise StorageError("Times must rise strictly.", code="time_not_increasing")
        batch.write.mode("append").partitionBy("ts").parquet(path)

    return write
