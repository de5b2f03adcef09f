"""What loops and Python workers need: checkpoints in the folder that all executors share, and this package on the workers."""

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A table is broadcast only after its rows have been counted and are at most so many.
BROADCAST_ROWS = 500_000


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a local session without one gets a folder of its own, a cluster an error."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="docketlens-"))
    return context.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def bounded_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint where the counted rows allow it; else the plain frame, which Spark joins by shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def ancestors(links: DataFrame) -> DataFrame:
    """(node, top, distance) of distinct nodes: the last ancestor, null for a node without parent, and the steps to it.

    links (node, parent) name a parent for each node, or null. By pointer doubling: each round every unfinished node
    takes over the ancestor and steps of the ancestor it knows, so that rounds grow with the logarithm of the longest
    chain and a node is one row throughout. Nodes that lead into a cycle never finish; they end with a null top and the
    distance -1. A parent that is no node itself is the last ancestor.
    """
    known = checkpoint(links.select("node", F.col("parent").alias("top"), F.when(F.col("parent").isNull(), 0).otherwise(1).cast("long").alias("distance"), F.col("parent").isNull().alias("done")))
    nodes = known.count()
    while not known.where("NOT done").isEmpty():
        step = known.select(F.col("node").alias("at"), F.col("top").alias("next"), F.col("distance").alias("more"))
        met = known.where("NOT done").join(step, F.col("top") == F.col("at"), "left")
        ended, far = F.col("next").isNull(), F.col("distance") + F.coalesce("more", F.lit(0))
        # No chain has as many steps as there are nodes and one more, unless it is a cycle.
        loop = far > nodes
        moved = met.select("node", F.when(~loop, F.coalesce("next", "top")).alias("top"), F.when(loop, -1).otherwise(far).cast("long").alias("distance"), (ended | loop).alias("done"))
        known = checkpoint(known.where("done").unionByName(moved))
    return known.drop("done")


def row_numbers(df: DataFrame, *order: str) -> DataFrame:
    """df with rn, the global row number from 0 in the order given, without a window over all rows in one task.

    Rows are dealt by ranges of the keys and kept in place by a checkpoint; only the counts of the partitions pass one
    task. The keys should tell rows apart: equal ones share a partition and have no fixed order.
    """
    tagged = checkpoint(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("row_id", F.monotonically_increasing_id()))
    tagged = tagged.withColumn("part", F.shiftright("row_id", 33)).withColumn("inside", F.col("row_id").bitwiseAND(F.lit((1 << 33) - 1)))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = tagged.groupBy("part").agg(F.count(F.lit(1)).alias("n_part")).select("part", F.coalesce(F.sum("n_part").over(before), F.lit(0)).alias("start"))
    return tagged.join(F.broadcast(starts), "part").select(*df.columns, (F.col("start") + F.col("inside")).alias("rn"))


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
