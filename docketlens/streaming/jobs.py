"""Streaming jobs over an event stream (ts, event_type, user_id, event_id, value): windows, limits, sessions, health, dedupe, upsert.

Each takes a streaming or a batch DataFrame, so that the batch result is the reference for the stream.
"""

import contextlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

LATE = "1 hour"


def timed(events: DataFrame) -> DataFrame:
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", LATE)


def run_counts(events: DataFrame, width: str = "1 day") -> DataFrame:
    """Runs of each source in windows that do not overlap (STR-1)."""
    g = timed(events).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return g.select(F.col("window.start").alias("start"), "event_type", "n")


def sliding_counts(events: DataFrame, width: str = "7 days", step: str = "1 day") -> DataFrame:
    """Requests of each user in sliding windows, for a rate limit (STR-2)."""
    g = timed(events).groupBy(F.window("ts", width, step), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return g.select(F.col("window.start").alias("start"), "user_id", "n")


def sessions(events: DataFrame, gap: str = "6 hours") -> DataFrame:
    """Spans of activity of each user, ended by a gap (STR-3)."""
    g = timed(events).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return g.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "user_id", "n")


def first_seen(events: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Each payload once: repeats within the watermark are dropped (STR-5)."""
    return timed(events).dropDuplicatesWithinWatermark(keys or ["event_id"])


class HealthMachine(StatefulProcessor):
    """Consecutive failures of a source: reset by a good run, failed at a threshold (STR-4)."""

    def __init__(self, threshold: int = 3, least: float = 5.0):
        self.threshold, self.least = threshold, least

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.failures = handle.getValueState("failures", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n = self.failures.get()[0] if self.failures.exists() else 0
        out = []
        # The rows of a source in one micro-batch, whose size the trigger bounds, are put in order together.
        for row in pd.concat(list(rows)).sort_values(["ts", "event_id"]).itertuples():
            n = 0 if row.value >= self.least else n + 1
            state = "HEALTHY" if n == 0 else "FAILED" if n >= self.threshold else "DEGRADED"
            out.append((key[0], row.event_id, n, state))
        yield pd.DataFrame(out, columns=["source", "event_id", "failures", "health"])
        self.failures.update((n,))

    def close(self) -> None:
        pass


HEALTH = "source string, event_id long, failures long, health string"


def health(events: DataFrame, threshold: int = 3, least: float = 5.0) -> DataFrame:
    """Streams only: the state of each source after each of its events."""
    rows = events.select("event_type", "event_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    return rows.groupBy("event_type").transformWithStateInPandas(HealthMachine(threshold, least), HEALTH, "Append", "None")


def upsert_to(path: str, keys: list[str], order: str | None = None, done: list[int] | None = None) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: each micro-batch becomes a version of the table that has the old rows but those replaced (STR-6).

    Of several rows of a key in a batch the last by order wins. A batch that runs again writes its version again. done, if
    given, gets the number of each version.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        old = spark.read.parquet(f"{path}/v{number - 1}") if number else None
        if order is None:
            last = batch.dropDuplicates(keys)
        else:
            last = batch.groupBy(*keys).agg(F.max_by(F.struct(*batch.columns), order).alias("row")).select("row.*")
        out = last if old is None else last.unionByName(old.join(last.select(*keys), keys, "left_anti"))
        out.write.mode("overwrite").parquet(f"{path}/v{number}")
        if done is not None:
            done.append(number)

    return write


@contextlib.contextmanager
def session_conf(spark: SparkSession, **values: str) -> Iterator[None]:
    """Settings (dots as double underscores) that hold inside only."""
    names = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def in_stretches(parts: list[DataFrame], folder: str) -> DataFrame:
    """A file stream over the parts, written one after the other, so that their files come in this order; one part a trigger at most."""
    spark = parts[0].sparkSession
    for number, part in enumerate(parts):
        part.write.mode("append").parquet(f"{folder}/part={number}")
    schema = spark.read.parquet(folder).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def drained(stream: DataFrame, folder: str) -> DataFrame:
    """Runs a stream to its end, with state and output in the folder, and gives its rows."""
    stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start(f"{folder}/out").awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")
