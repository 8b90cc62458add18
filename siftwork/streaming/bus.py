"""The event bus as streaming queries: windows over event time, exact suppression of repeats, spikes by key."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout


def read_events(spark: SparkSession, path: str, schema, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def windowed(events: DataFrame, window: str = "1 hour", late: str = "1 day", ts: str = "ts") -> DataFrame:
    """Counts and sums by event-time window and type; rows later than the watermark are dropped."""
    e = events.withWatermark(ts, late).groupBy(F.window(ts, window).alias("w"), "event_type")
    return e.agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def without_repeats(events: DataFrame, columns: list[str], late: str = "1 day", ts: str = "ts") -> DataFrame:
    """Each payload once within the watermark, for state that does not grow."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(columns)


def spikes(events: DataFrame, key: str = "user_id", order: str = "event_id", value: str = "value", k: float = 3.0, least: int = 3) -> DataFrame:
    """Rows (key, order, value, spike): over the mean of the key's earlier values by k deviations.

    Each key's state is a count, a mean and a sum of squares (Welford), tested before it takes the new value
    in; within a micro-batch the rows of a key are taken in order.
    """

    def step(group, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, mean, square = state.get if state.exists else (0, 0.0, 0.0)
        pdf = pd.concat(list(frames)).sort_values(order)
        out = []
        for x in pdf[value]:
            deviation = (square / (n - 1)) ** 0.5 if n > 1 else 0.0
            out.append(bool(n >= least and deviation > 0 and x > mean + k * deviation))
            n += 1
            delta = x - mean
            mean += delta / n
            square += delta * (x - mean)
        state.update((n, mean, square))
        yield pd.DataFrame({key: pdf[key], order: pdf[order], value: pdf[value], "spike": out})

    rows = events.select(key, order, value)
    return rows.groupBy(key).applyInPandasWithState(step, f"{key} long, {order} long, {value} double, spike boolean", "n long, mean double, square double", "append", GroupStateTimeout.NoTimeout)


def run_to_end(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Runs a streaming query over what there is, and returns the table it wrote.

    Append writes files; complete writes the whole result of each batch, of which the last stands.
    """
    spark = stream.sparkSession
    place = f"{folder.rstrip('/')}/stream-{uuid.uuid4().hex}"
    writer = stream.writeStream.option("checkpointLocation", f"{place}/checkpoint").trigger(availableNow=True).outputMode(mode)
    if mode == "append":
        running = writer.format("parquet").option("path", f"{place}/out").start()
    else:
        running = writer.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{place}/out")).start()
    running.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{place}/out")
