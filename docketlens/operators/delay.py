"""Delay baselines at several levels, normalisation against them and anomalies (DEL)."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketlens.functions.numbers import clamp
from docketlens.operators.advocates import GAPS_SQL, gaps
from docketlens.plans.fallback import choose_level
from docketlens.plans.registry import query
from docketlens.sources.domain import Tables

#: The levels, finest first, and the keys of each.
LEVELS = (("court_case_type", ("court_id", "case_type")), ("court", ("court_id",)), ("state_case_type", ("state", "case_type")), ("state", ("state",)), ("national_case_type", ("case_type",)), ("national", ()))
#: Smallest sample of a level that is taken without falling back.
MIN_SAMPLE = 100


def case_delays(spans: DataFrame, as_of: Column, window_years: int | None = None) -> DataFrame:
    """Days from filing to disposal, or to the reference date; a disposed case without a date counts to that date too."""
    end = F.when(F.col("is_disposed"), F.coalesce("disposal_date", as_of)).otherwise(as_of)
    kept = spans.where("filing_date IS NOT NULL")
    if window_years:
        kept = kept.where(F.col("filing_date") >= F.date_sub(as_of, window_years * 365))
    delay = F.greatest(F.lit(0), F.datediff(end, "filing_date")).cast("long")
    kind = F.coalesce(F.nullif(F.lower(F.trim("case_type")), F.lit("")), F.lit("unknown"))
    return kept.select("case_id", "court_id", "state", kind.alias("case_type"), "is_disposed", "importance", delay.alias("delay"), "filing_date")


DELAYS_SQL = """, delays AS (SELECT case_id, court_id, state, coalesce(nullif(lower(trim(case_type)), ''), 'unknown') AS case_type, is_disposed, importance, filing_date,
  greatest(0, date_diff('day', filing_date, CASE WHEN is_disposed THEN coalesce(disposal_date, DATE '2001-12-31') ELSE DATE '2001-12-31' END)) AS delay
  FROM case_spans WHERE filing_date IS NOT NULL AND filing_date >= DATE '2001-12-31' - 2555)"""

BASELINES_SQL = (
    DELAYS_SQL
    + """, base AS (SELECT CASE WHEN court_id IS NOT NULL AND case_type IS NOT NULL THEN 'court_case_type' WHEN court_id IS NOT NULL THEN 'court' WHEN state IS NOT NULL AND case_type IS NOT NULL THEN 'state_case_type'
    WHEN state IS NOT NULL THEN 'state' WHEN case_type IS NOT NULL THEN 'national_case_type' ELSE 'national' END AS level, court_id, state, case_type,
    round(greatest(1, quantile_cont(delay, 0.5)), 4) AS median, round(greatest(1, quantile_cont(delay, 0.75)), 4) AS p75, round(greatest(1, quantile_cont(delay, 0.9)), 4) AS p90,
    round(greatest(1, quantile_cont(delay, 0.75) - quantile_cont(delay, 0.25)), 4) AS iqr, count(*) AS n
    FROM delays GROUP BY GROUPING SETS ((court_id, case_type), (court_id), (state, case_type), (state), (case_type), ()))"""
)


def baselines(delays: DataFrame) -> DataFrame:
    """Median, p75, p90 and spread at all levels by one GROUPING SETS; exact percentiles with linear interpolation.

    Equal delays of a court and type are counted first, so that the levels expand these counts and not the cases.
    """
    sets = [[F.col(k) for k in keys] for _, keys in LEVELS]
    counts = delays.groupBy("court_id", "state", "case_type", "delay").agg(F.count(F.lit(1)).alias("m"))
    p = F.percentile("delay", [0.25, 0.5, 0.75, 0.9], F.col("m"))
    stats = counts.groupingSets(sets, "court_id", "state", "case_type").agg(p.alias("p"), F.sum("m").alias("n"))
    has = lambda *keys: F.lit(True) if not keys else F.col(keys[0]).isNotNull() if len(keys) == 1 else F.col(keys[0]).isNotNull() & F.col(keys[1]).isNotNull()
    level = F.when(has(*LEVELS[0][1]), LEVELS[0][0])
    for name, keys in LEVELS[1:]:
        level = level.when(has(*keys), name)
    floor = lambda c: F.round(F.greatest(F.lit(1.0), c), 4)
    return stats.select(level.alias("level"), "court_id", "state", "case_type", floor(F.col("p")[1]).alias("median"), floor(F.col("p")[2]).alias("p75"), floor(F.col("p")[3]).alias("p90"), floor(F.col("p")[2] - F.col("p")[0]).alias("iqr"), "n")


@query("del_1_delays", DELAYS_SQL + " SELECT case_id, CAST(delay AS BIGINT) AS delay FROM delays")
def delays_query(t: Tables) -> DataFrame:
    return case_delays(t.case_spans, t.as_of, 7).select("case_id", "delay")


@query("del_2_baselines", BASELINES_SQL + " SELECT * FROM base")
def baselines_query(t: Tables) -> DataFrame:
    return baselines(case_delays(t.case_spans, t.as_of, 7))


WEIGHTED_SQL = (
    DELAYS_SQL
    + """, wt AS (SELECT *, pow(0.5, date_diff('day', filing_date, DATE '2001-12-31') / 730.0) AS w FROM delays),
    ws AS (SELECT CASE WHEN court_id IS NOT NULL AND case_type IS NOT NULL THEN 0 WHEN court_id IS NOT NULL THEN 1 WHEN state IS NOT NULL AND case_type IS NOT NULL THEN 2 WHEN state IS NOT NULL THEN 3 WHEN case_type IS NOT NULL THEN 4 ELSE 5 END AS depth,
      court_id, state, case_type, delay, sum(w) AS w, count(*) AS n FROM wt GROUP BY GROUPING SETS ((court_id, case_type, delay), (court_id, delay), (state, case_type, delay), (state, delay), (case_type, delay), (delay))),
    wc AS (SELECT *, sum(w) OVER (PARTITION BY depth, court_id, state, case_type ORDER BY delay) AS upto, sum(w) OVER (PARTITION BY depth, court_id, state, case_type) AS total FROM ws),
    wb AS (SELECT depth, court_id, state, case_type, min(delay) FILTER (upto >= total / 2 * (1 - 1e-12)) AS weighted_median, CAST(sum(n) AS BIGINT) AS n FROM wc GROUP BY 1, 2, 3, 4)"""
)


def weighted_baselines(delays: DataFrame, as_of: Column, half_life: int = 730) -> DataFrame:
    """The median delay at all levels with weights that halve with a case's age.

    Equal delays are summed up at each level by one GROUPING SETS, so that the running weights of a level, the national
    one included, pass over at most as many rows as there are different delays.
    """
    weight = F.pow(F.lit(0.5), F.datediff(as_of, "filing_date") / half_life)
    sets = [[*[F.col(k) for k in keys], F.col("delay")] for _, keys in LEVELS]
    has = lambda keys: [F.col(k).isNotNull() for k in keys]
    level = F.when(has(LEVELS[0][1])[0] & has(LEVELS[0][1])[1], LEVELS[0][0])
    for name, keys in LEVELS[1:]:
        found = F.lit(True)
        for test in has(keys):
            found = found & test
        level = level.when(found, name)
    sums = delays.withColumn("weight", weight).groupingSets(sets, "court_id", "state", "case_type", "delay").agg(F.sum("weight").alias("weight"), F.count(F.lit(1)).alias("m"))
    group = ["level", "court_id", "state", "case_type"]
    sums = sums.select(level.alias("level"), *group[1:], "delay", "weight", "m")
    upto, total = F.sum("weight").over(Window.partitionBy(*group).orderBy("delay")), F.sum("weight").over(Window.partitionBy(*group))
    marked = sums.withColumn("reached", upto >= total / 2 * (1 - 1e-12))
    return marked.groupBy(*group).agg(F.min(F.when(F.col("reached"), F.col("delay"))).alias("weighted_median"), F.sum("m").alias("n"))


_DEPTHS = "CASE depth " + " ".join(f"WHEN {i} THEN '{name}'" for i, (name, _) in enumerate(LEVELS)) + " END"


@query("del_3_weighted_baselines", WEIGHTED_SQL + f" SELECT {_DEPTHS} AS level, court_id, state, case_type, CAST(weighted_median AS BIGINT) AS weighted_median, n FROM wb")
def weighted_query(t: Tables) -> DataFrame:
    return weighted_baselines(case_delays(t.case_spans, t.as_of, 7), t.as_of)


@query(
    "del_3_weighted_choice",
    WEIGHTED_SQL
    + f""", wj AS (SELECT d.case_id, b.weighted_median, b.n, b.depth FROM delays d JOIN wb b ON (b.depth = 0 AND b.court_id = d.court_id AND b.case_type = d.case_type) OR (b.depth = 1 AND b.court_id = d.court_id)
      OR (b.depth = 2 AND b.state = d.state AND b.case_type = d.case_type) OR (b.depth = 3 AND b.state = d.state) OR (b.depth = 4 AND b.case_type = d.case_type) OR b.depth = 5)
    SELECT case_id, CAST(weighted_median AS BIGINT) AS weighted_median, {_DEPTHS} AS level FROM wj QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY n < 100, depth) = 1""",
)
def weighted_choice(t: Tables) -> DataFrame:
    """Each case's weighted median, from the level that the fallback of del_4 takes."""
    delays = case_delays(t.case_spans, t.as_of, 7)
    return choose_level(delays, weighted_baselines(delays, t.as_of), LEVELS, ["weighted_median", "n"], MIN_SAMPLE).select("case_id", "weighted_median", "level")


CHOSEN_SQL = (
    BASELINES_SQL
    + """, cand AS (SELECT d.case_id, d.delay, b.median, b.p75, b.p90, b.iqr, b.n, b.level,
      CASE b.level WHEN 'court_case_type' THEN 0 WHEN 'court' THEN 1 WHEN 'state_case_type' THEN 2 WHEN 'state' THEN 3 WHEN 'national_case_type' THEN 4 ELSE 5 END AS depth
      FROM delays d JOIN base b ON (b.level = 'court_case_type' AND b.court_id = d.court_id AND b.case_type = d.case_type) OR (b.level = 'court' AND b.court_id = d.court_id)
        OR (b.level = 'state_case_type' AND b.state = d.state AND b.case_type = d.case_type) OR (b.level = 'state' AND b.state = d.state) OR (b.level = 'national_case_type' AND b.case_type = d.case_type) OR b.level = 'national'),
    chosen AS (SELECT * FROM cand QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY n < 100, depth) = 1),
    norm AS (SELECT *, delay / greatest(1, median) AS ratio, (delay - median) / greatest(1, iqr) AS z,
      CASE WHEN delay <= median THEN delay / greatest(1, median) * 50 WHEN delay <= p75 THEN 50 + 25 * (delay - median) / greatest(1, p75 - median) WHEN delay <= p90 THEN 75 + 15 * (delay - p75) / greatest(1, p90 - p75)
      ELSE least(99.9, 90 + 10 * (delay - p90) / greatest(1, p90 - median)) END AS pct FROM chosen),
    sev AS (SELECT *, CASE WHEN ratio >= 3 OR pct >= 99 OR z >= 3 THEN 'EXTREME_DELAY' WHEN ratio >= 2 OR pct >= 95 OR z >= 2 THEN 'HIGH_DELAY' WHEN ratio >= 1.5 OR pct >= 90 THEN 'MODERATE_DELAY' ELSE 'NORMAL' END AS severity FROM norm)"""
)


def with_baseline(delays: DataFrame, base: DataFrame, minimum: int = MIN_SAMPLE) -> DataFrame:
    return choose_level(delays, base, LEVELS, ["median", "p75", "p90", "iqr", "n"], minimum)


def normalised(chosen: DataFrame) -> DataFrame:
    """Ratio, robust z and piecewise percentile of a delay against its baseline, unrounded."""
    d, one = F.col("delay"), F.lit(1.0)
    over = lambda low, span: (d - F.col(low)) / F.greatest(one, span)
    pct = (
        F.when(d <= F.col("median"), d / F.greatest(one, F.col("median")) * 50)
        .when(d <= F.col("p75"), 50 + 25 * over("median", F.col("p75") - F.col("median")))
        .when(d <= F.col("p90"), 75 + 15 * over("p75", F.col("p90") - F.col("p75")))
        .otherwise(F.least(F.lit(99.9), 90 + 10 * over("p90", F.col("p90") - F.col("median"))))
    )
    return chosen.withColumn("ratio", d / F.greatest(one, F.col("median"))).withColumn("z", over("median", F.col("iqr"))).withColumn("pct", pct)


def severity(ratio: Column, pct: Column, z: Column) -> Column:
    return (
        F.when((ratio >= 3) | (pct >= 99) | (z >= 3), "EXTREME_DELAY")
        .when((ratio >= 2) | (pct >= 95) | (z >= 2), "HIGH_DELAY")
        .when((ratio >= 1.5) | (pct >= 90), "MODERATE_DELAY")
        .otherwise("NORMAL")
    )


def scored(t: Tables) -> DataFrame:
    delays = case_delays(t.case_spans, t.as_of, 7)
    return normalised(with_baseline(delays, baselines(delays))).withColumn("severity", severity(F.col("ratio"), F.col("pct"), F.col("z")))


@query("del_4_choose_baseline", CHOSEN_SQL + " SELECT case_id, level, CAST(depth AS INTEGER) AS depth, n FROM chosen")
def choose_baseline(t: Tables) -> DataFrame:
    delays = case_delays(t.case_spans, t.as_of, 7)
    return with_baseline(delays, baselines(delays)).select("case_id", "level", "depth", "n")


@query("del_5_normalize", CHOSEN_SQL + " SELECT case_id, round(ratio, 4) AS ratio, round(pct, 2) AS pct, round(z, 4) AS z FROM norm")
def normalize(t: Tables) -> DataFrame:
    return scored(t).select("case_id", F.round("ratio", 4).alias("ratio"), F.round("pct", 2).alias("pct"), F.round("z", 4).alias("z"))


@query("del_6_severity", CHOSEN_SQL + " SELECT case_id, severity FROM sev")
def severities(t: Tables) -> DataFrame:
    return scored(t).select("case_id", "severity")


def baseline_confidence(n: Column, age_days: Column, median: Column, iqr: Column, depth: Column) -> Column:
    """Sample, recency and spread, less for every level that was fallen back."""
    spread = F.when(median <= 0, 0.4).otherwise(F.greatest(F.lit(0.2), 1 - F.least(F.lit(1.0), iqr / F.greatest(F.lit(1.0), median))))
    recency = F.greatest(F.lit(0.2), 1 - age_days / 3650)
    return clamp((0.45 * F.least(F.lit(1.0), n / 150) + 0.25 * recency + 0.30 * spread) * F.greatest(F.lit(0.5), 1 - 0.08 * depth))


@query(
    "del_7_confidence",
    CHOSEN_SQL
    + """ SELECT case_id, round(least(1, greatest(0, (0.45 * least(1, n / 150) + 0.25 * greatest(0.2, 1 - 30 / 3650) + 0.30 * CASE WHEN median <= 0 THEN 0.4 ELSE greatest(0.2, 1 - least(1, iqr / greatest(1, median))) END) * greatest(0.5, 1 - 0.08 * depth))), 4) AS confidence FROM chosen""",
)
def confidences(t: Tables, baseline_age: int = 30) -> DataFrame:
    c = baseline_confidence(F.col("n"), F.lit(float(baseline_age)), F.col("median"), F.col("iqr"), F.col("depth"))
    return scored(t).select("case_id", F.round(c, 4).alias("confidence"))


@query("del_8_flags", CHOSEN_SQL + " SELECT case_id, 'baseline_delay_anomaly' AS flag_type, round(ratio, 4) AS score FROM norm WHERE ratio >= 1.5 OR pct >= 90 OR z >= 2")
def flags(t: Tables) -> DataFrame:
    return scored(t).where("ratio >= 1.5 OR pct >= 90 OR z >= 2").select("case_id", F.lit("baseline_delay_anomaly").alias("flag_type"), F.round("ratio", 4).alias("score"))


@query(
    "del_9_court_anomalies",
    GAPS_SQL
    + """, g AS (SELECT court_id, median(gap) AS med FROM gaps JOIN cases USING (case_id) WHERE gap IS NOT NULL GROUP BY 1),
    r AS (SELECT court_id, case_id, CASE WHEN n_hearings = 0 THEN 0 ELSE n_adjourned / n_hearings END AS rate, coalesce(date_diff('day', last_hearing, DATE '2001-12-31'), 0) AS idle FROM case_spans),
    s AS (SELECT court_id, avg(rate) AS m, stddev_pop(rate) AS sd FROM r GROUP BY 1)
    SELECT case_id, idle > 2 * med AS idle_flag, rate > m + 2 * sd AS rate_flag FROM r JOIN s USING (court_id) JOIN g USING (court_id) WHERE idle > 2 * med OR rate > m + 2 * sd""",
)
def court_anomalies(t: Tables) -> DataFrame:
    """Long without a hearing against the court's median gap, or adjourned often against its mean; courts without gaps are passed over."""
    g = gaps(t.hearings).where("gap IS NOT NULL").select("case_id", "gap").join(t.cases.select("case_id", "court_id"), "case_id").groupBy("court_id").agg(F.median("gap").alias("med"))
    r = t.case_spans.select("court_id", "case_id", F.coalesce(F.try_divide("n_adjourned", "n_hearings"), F.lit(0.0)).alias("rate"), F.coalesce(F.datediff(t.as_of, "last_hearing"), F.lit(0)).alias("idle"))
    s = r.groupBy("court_id").agg(F.avg("rate").alias("m"), F.stddev_pop("rate").alias("sd"))
    idle, often = F.col("idle") > 2 * F.col("med"), F.col("rate") > F.col("m") + 2 * F.col("sd")
    return r.join(s, "court_id").join(g, "court_id").where(idle | often).select("case_id", idle.alias("idle_flag"), often.alias("rate_flag"))


@query("del_10_time_to_disposal", "SELECT case_id, date_diff('day', filing_date, last_hearing) AS days FROM case_spans WHERE lower(status) = 'disposed'")
def time_to_disposal(t: Tables) -> DataFrame:
    return t.case_spans.where(F.lower("status") == "disposed").select("case_id", F.datediff("last_hearing", "filing_date").cast("long").alias("days"))


@query("del_11_judge_rates", "SELECT judge_id, round(count(*) FILTER (outcome_type = 'ADJOURNED') / count(*), 6) AS rate FROM hearings GROUP BY 1")
def judge_rates(t: Tables) -> DataFrame:
    return t.hearings.groupBy("judge_id").agg(F.round(F.count_if(F.col("outcome_type") == "ADJOURNED") / F.count(F.lit(1)), 6).alias("rate"))
