"""Mixing sources to target weights by entropy balancing.

Document i of a source takes part with the rate w_i = min(cap, exp(t * size_i / mean)), the weights closest to one in
relative entropy under the source's token constraint sum(w_i * size_i) = target and the bound cap. The tilt t of each
source solves the convex dual by Newton's method: every iteration is one aggregation over the counts of documents by
source and size, for all sources at once, with a bracket that catches steps which leave it. Rates then become whole
copies by systematic rounding along the documents of a source in order of size, and single copies settle the rest.
"""

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketlens.llm.common import WORD, bounded_broadcast, checkpoint, numbered

#: Weights of the sources in code point order, repeating.
WEIGHTS = (5, 2, 1)
#: No document and no source is taken more often than this.
CAP = 3
#: Rates are whole multiples of one over this, so that their sums are exact.
UNIT = 1 << 20
#: Relative error at which a source's tilt is solved, and the bound on iterations.
CLOSE = 1e-10
ITERATIONS = 80
#: Decimal digits of a tilt that count; beyond them the order of summation could show.
DIGITS = 9
#: Rounds that settle what rounding left by one copy in each source.
SETTLING = 2


def _same(a: str, b: str = "source") -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def source_targets(hist: DataFrame, weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """(source, source_size, source_docs, smallest, place, target) from counts n by source and size.

    All sizes are shared by weight; no target exceeds cap times its source. With r = cap * size / weight in ascending
    order, the first source whose share at the level left by those before it stays within its cap sets the level.
    """
    sums = hist.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"), F.sum("n").alias("source_docs"), F.min(F.when(F.col("size") > 0, F.col("size"))).alias("smallest"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    table = F.array(*[F.lit(float(w)) for w in weights])
    named = sums.withColumn("place", F.row_number().over(by_name) - 1).withColumn("weight", F.get(table, F.col("place") % len(weights)))
    by_limit = Window.orderBy("limit", "place")
    all_rows = Window.partitionBy(F.lit(0))
    ranked = named.withColumn("limit", cap * F.col("source_size") / F.col("weight"))
    before = F.coalesce(F.sum(cap * F.col("source_size")).over(by_limit.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    after = F.sum("weight").over(by_limit.rowsBetween(0, Window.unboundedFollowing))
    level = ranked.withColumn("level", (F.sum("source_size").over(all_rows) - before) / after)
    chosen = level.withColumn("chosen", F.min(F.when(F.col("level") <= F.col("limit"), F.struct("limit", "place", "level"))).over(all_rows)["level"])
    target = F.least(F.col("weight") * F.coalesce("chosen", F.lit(math.inf)), cap * F.col("source_size").cast("double"))
    return chosen.select("source", "source_size", "source_docs", "smallest", F.col("place").cast("long").alias("place"), target.alias("target"))


def _rate(size: Column, cap: int = CAP) -> Column:
    power = F.col("tilt") * size / F.col("mean")
    return F.when(power >= math.log(cap), F.lit(float(cap))).otherwise(F.exp(F.least(power, F.lit(math.log(cap)))))


def solve_tilts(hist: DataFrame, targets: DataFrame, cap: int = CAP) -> DataFrame:
    """targets with mean and tilt: Newton's method on the dual of every source at once.

    Sources without words keep the tilt 0. The state has a row for each source; it is checkpointed at every iteration,
    so that a lost executor costs one iteration at most.
    """
    mean = F.col("source_size") / F.col("source_docs")
    live = (F.col("source_size") > 0) & (F.col("target") > 0)
    low = F.least(F.lit(0.0), F.ln(F.col("target") / F.col("source_size"))) * F.col("mean") / F.col("smallest")
    high = F.lit(math.log(cap)) * F.col("mean") / F.col("smallest")
    full = F.col("target") >= cap * F.col("source_size")
    state = targets.withColumn("mean", mean).withColumn("low", F.when(live, low)).withColumn("high", F.when(live, high))
    state = state.withColumn("tilt", F.when(live & full, F.col("high")).otherwise(F.lit(0.0))).withColumn("solved", ~live | full)
    state = checkpoint(state)
    counts = hist.where(F.col("size") > 0).withColumnRenamed("source", "of")
    for _ in range(ITERATIONS):
        if state.where(~F.col("solved")).isEmpty():
            break
        rate = _rate(F.col("size"), cap)
        mass = F.col("n") * F.col("size") * rate
        slope = F.when(rate < cap, mass * F.col("size") / F.col("mean")).otherwise(0.0)
        own = bounded_broadcast(state.where(~F.col("solved")).select("source", "tilt", "mean"))
        sums = counts.join(own, _same("of")).groupBy("source").agg(F.sum(mass).alias("mass"), F.sum(slope).alias("slope")).withColumnRenamed("source", "of")
        over = F.col("mass") - F.col("target")
        step = state.join(bounded_broadcast(sums), _same("of"), "left").withColumn("over", over)
        step = step.withColumn("low", F.when(F.col("over") < 0, F.col("tilt")).otherwise(F.col("low"))).withColumn("high", F.when(F.col("over") > 0, F.col("tilt")).otherwise(F.col("high")))
        newton = F.col("tilt") - F.try_divide("over", "slope")
        step = step.withColumn("done", F.col("solved") | (F.abs("over") <= CLOSE * F.col("target")) | (F.col("high") - F.col("low") <= 1e-14))
        moved = F.when((newton > F.col("low")) & (newton < F.col("high")), newton).otherwise((F.col("low") + F.col("high")) / 2)
        step = step.withColumn("tilt", F.when(F.col("done"), F.col("tilt")).otherwise(moved)).withColumn("solved", F.coalesce("done", F.lit(True)))
        state = checkpoint(step.select(state.columns))
    else:
        if not state.where(~F.col("solved")).isEmpty():
            raise RuntimeError(f"tilts are not solved after {ITERATIONS} iterations")
    return state.withColumn("tilt", F.round("tilt", DIGITS)).drop("low", "high", "solved")


def mix(docs: DataFrame, weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """One row per document: doc_id, source, text_key, size, source_size, target, rate, copies, taken.

    A null text has size 0 and is never taken; a null source is a source of its own, last in order. Equal rows may
    get copies that differ by one, as any documents of equal size may. An empty table gives an empty result.
    """
    size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long")
    sized = checkpoint(docs.select("doc_id", "source", F.xxhash64("text").alias("text_key"), size.alias("size")))
    hist = checkpoint(sized.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")))
    solved = solve_tilts(hist, checkpoint(source_targets(hist, weights, cap)), cap)
    solved = checkpoint(solved.withColumn("start", F.coalesce(F.sum("source_docs").over(Window.orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))))
    before = Window.partitionBy("place").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    groups = hist.withColumnRenamed("source", "of").join(bounded_broadcast(solved), _same("of")).withColumn("unit_rate", F.round(_rate(F.col("size"), cap) * UNIT).cast("long"))
    groups = checkpoint(
        groups.select(
            "of",
            F.col("size").alias("of_size"),
            "source_size",
            "target",
            "place",
            "unit_rate",
            (F.col("start") + F.coalesce(F.sum("n").over(before), F.lit(0))).alias("first_row"),
            F.coalesce(F.sum(F.col("n") * F.col("unit_rate")).over(before), F.lit(0)).alias("rate_before"),
        )
    )
    rows = numbered(sized, "source", "size", "doc_id", "text_key")
    joined = rows.join(bounded_broadcast(groups), _same("of") & (F.col("size") == F.col("of_size")))
    at = F.col("rate_before") + (F.col("row_number") - F.col("first_row")) * F.col("unit_rate") + UNIT // 2
    copies = F.floor((at + F.col("unit_rate")) / UNIT) - F.floor(at / UNIT)
    out = joined.withColumn("copies", F.when(F.col("size") > 0, copies).otherwise(0).cast("long"))
    out = out.select("row_number", "place", "doc_id", "source", "text_key", "size", "source_size", "target", (F.col("unit_rate") / UNIT).alias("rate"), "copies")
    for _ in range(SETTLING):
        out = _settle(checkpoint(out), cap)
    return out.select("doc_id", "source", "text_key", "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def _settle(rows: DataFrame, cap: int) -> DataFrame:
    """One copy more or less in each source, of the document whose size is closest to what is missing or too much."""
    sums = rows.groupBy("place").agg((F.first("target") - F.sum(F.col("copies") * F.col("size"))).alias("missing"))
    sums = bounded_broadcast(sums.withColumnRenamed("place", "at"))
    change = F.when((F.col("missing") > 0) & (F.col("copies") < cap), 1).when((F.col("missing") < 0) & (F.col("copies") > 0), -1)
    left = F.abs(F.col("missing") - change * F.col("size"))
    best = rows.join(sums, F.col("place") == F.col("at")).where((F.col("size") > 0) & (left < F.abs("missing"))).groupBy("place").agg(F.min(F.struct(left.alias("left"), F.col("row_number").alias("best"), change.alias("change"))).alias("b"))
    picks = bounded_broadcast(best.select("b.best", "b.change"))
    return rows.join(picks, F.col("row_number") == F.col("best"), "left").withColumn("copies", F.col("copies") + F.coalesce("change", F.lit(0))).drop("best", "change")


def take(docs: DataFrame, weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """The mixed corpus: every document as often as mix() takes it, with all its columns.

    Rows that agree in doc_id, source and text are one document here; their copies add up.
    """
    names = docs.columns
    copies = mix(docs, weights, cap).groupBy("doc_id", "source", "text_key").agg(F.sum("copies").alias("copies")).where(F.col("copies") > 0)
    copies = copies.select(F.col("doc_id").alias("a"), F.col("source").alias("b"), F.col("text_key").alias("c"), "copies")
    whole = docs.select(F.struct(*[docs[c] for c in names]).alias("row"), F.col("doc_id").alias("x"), F.col("source").alias("y"), F.xxhash64("text").alias("z")).dropDuplicates(["x", "y", "z"])
    taken = whole.join(copies, _same("a", "x") & _same("b", "y") & (F.col("c") == F.col("z")))
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*[F.col(f"row.`{c}`").alias(c) for c in names])
