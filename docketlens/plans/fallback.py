"""Fallback along levels of aggregation: the finest level with a large enough sample, else the finest there is."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def choose_level(rows: DataFrame, stats: DataFrame, levels, values: list[str], minimum: int, sample: str = "n", else_last: bool = False) -> DataFrame:
    """rows with values, level and depth of the level chosen for each; null and depth len(levels) where none exists.

    Where no level has the sample, the finest one that exists is taken, or with else_last the last of all levels.

    Each level is one left join on its keys. The statistics have a row for each group, so Spark broadcasts them by
    their size, and the rows stay where they are.
    """
    out, found = rows, []
    for depth, (name, keys) in enumerate(levels):
        own = stats.where(F.col("level") == name).select(*[F.col(k).alias(f"__{depth}_{k}") for k in keys], F.struct(*values, F.lit(name).alias("level"), F.lit(depth).alias("depth")).alias(f"__{depth}"))
        on = F.lit(True)
        for k in keys:
            on = on & (F.col(k) == F.col(f"__{depth}_{k}"))
        out = out.join(own, on, "left")
        found.append(F.col(f"__{depth}"))
    enough = [F.when(f[sample] >= minimum, f) for f in found]
    out = out.withColumn("__best", F.coalesce(*enough, *(found[-1:] if else_last else found)))
    return out.select(*rows.columns, *[F.col(f"__best.{v}").alias(v) for v in values], F.col("__best.level").alias("level"), F.coalesce("__best.depth", F.lit(len(levels))).alias("depth"))
