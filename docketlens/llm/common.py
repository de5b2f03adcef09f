"""Helpers shared by the training-data operators."""

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A table is broadcast only after its rows have been counted and are at most so many.
BROADCAST_ROWS = 500_000

#: A run of characters that are not ASCII white space; the word of every contract here.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: the session's spark.checkpoint.dir.

    Where it is unset, a local session, as in tests, gets a folder of its own; on a cluster that is an error, as no
    folder of the driver's machine would do.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="docketlens-"))
    return context.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder; cuts the lineage and survives lost executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once per context, so that no install is needed on executors."""
    context = spark.sparkContext
    if getattr(context, "_docketlens_shipped", False):
        return
    package = Path(__file__).resolve().parents[1]
    target = os.path.join(tempfile.mkdtemp(prefix="docketlens-"), "docketlens.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, f"{package.name}/{p.relative_to(package)}")
    context.addPyFile(target)
    context._docketlens_shipped = True


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether df has at most so many rows; reads no more than that."""
    return df.limit(rows + 1).count() <= rows


def bounded_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint where the counted rows allow it; else the plain frame, which Spark joins by shuffle."""
    return F.broadcast(df) if small(df, rows) else df


def let(value: Column, body) -> Column:
    """Evaluates value once and hands it to body; keeps Catalyst from inlining it into a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def numbered(df: DataFrame, *order: str, name: str = "row_number") -> DataFrame:
    """Adds the global row number from 0 by the columns given, without a single-task window.

    Rows equal in those columns are interchangeable; the scan position breaks such ties, so that a value
    which a third of the rows share is still dealt over many tasks. Only the counts by partition pass one task.
    """
    keys = [F.col(c).asc_nulls_last() for c in order]
    ranged = df.withColumn("__at", F.monotonically_increasing_id()).repartitionByRange(*keys, "__at").sortWithinPartitions(*keys, "__at").drop("__at")
    tagged = checkpoint(ranged.withColumn("__id", F.monotonically_increasing_id()))
    tagged = tagged.withColumn("__part", F.shiftright("__id", 33)).withColumn("__in", F.col("__id").bitwiseAND(F.lit((1 << 33) - 1)))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = tagged.groupBy("__part").agg(F.count(F.lit(1)).alias("__n")).select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    return tagged.join(F.broadcast(starts), "__part").withColumn(name, F.col("__start") + F.col("__in")).drop("__id", "__part", "__in", "__n", "__start")
