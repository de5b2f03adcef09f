"""Survival analysis of case durations: Kaplan-Meier curves by stratum, hazards, prediction and flags (SUR)."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketlens.functions.numbers import clamp
from docketlens.operators.advocates import latest_judge
from docketlens.plans.registry import query
from docketlens.sources.domain import Tables

MIN_SAMPLE = 25
SMOOTHING = 7
HORIZON = 1825
#: Strata: name and keys.
STRATA = (("national", ()), ("court", ("court_id",)), ("court_case_type", ("court_id", "case_type")), ("state", ("state",)), ("state_case_type", ("state", "case_type")), ("case_type", ("case_type",)), ("judge", ("judge_id",)))


def durations(t: Tables, judges: bool = True) -> DataFrame:
    """Duration in days and whether it ended: disposed cases to their disposal, the others to the reference date.

    Without judges, judge_id is left out, and with it the sort of all hearings that finds the latest judge.
    """
    end = F.when(F.col("is_disposed"), F.coalesce("disposal_date", t.as_of)).otherwise(t.as_of)
    days = F.greatest(F.lit(0), F.datediff(end, "filing_date")).cast("long")
    rows = t.case_spans.join(latest_judge(t).select("case_id", "judge_id"), "case_id", "left") if judges else t.case_spans
    return rows.select("case_id", "court_id", "state", "case_type", *(["judge_id"] if judges else []), days.alias("duration"), F.col("is_disposed").cast("long").alias("event"), F.datediff(t.as_of, "filing_date").cast("long").alias("age"))


DUR_SQL = """, dur AS (SELECT c.case_id, court_id, state, case_type, j.judge_id, greatest(0, date_diff('day', filing_date, CASE WHEN is_disposed THEN coalesce(disposal_date, DATE '2001-12-31') ELSE DATE '2001-12-31' END)) AS duration,
  CAST(is_disposed AS BIGINT) AS event, date_diff('day', filing_date, DATE '2001-12-31') AS age
  FROM case_spans c LEFT JOIN (SELECT case_id, arg_max(judge_id, (date, line, part, judge_id, price)) AS judge_id FROM hearings GROUP BY 1) j USING (case_id))"""


@query("sur_1_durations", DUR_SQL + " SELECT case_id, judge_id, duration, event FROM dur")
def durations_query(t: Tables) -> DataFrame:
    return durations(t).select("case_id", "judge_id", "duration", "event")


def strata(rows: DataFrame, kinds=STRATA) -> DataFrame:
    """Counts of ends and censorings by stratum and time, for all groupings from one pass: counts by time and finest keys are exploded, not cases."""
    keys = [k for k in ("court_id", "state", "case_type", "judge_id") if k in rows.columns]
    fine = rows.groupBy(*keys, F.col("duration").alias("time")).agg(F.sum("event").alias("d"), F.count(F.lit(1)).alias("m"))
    label = lambda ks: F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("unknown")) for k in ks]) if ks else F.lit("all")
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("kind"), label(ks).alias("key")) for name, ks in kinds]))
    return fine.select("time", "d", "m", each.alias("s")).groupBy("s.kind", "s.key", "time").agg(F.sum("d").alias("d"), F.sum("m").alias("m"))


def at_risk(times: DataFrame, minimum: int = MIN_SAMPLE) -> DataFrame:
    """Adds n, those still at risk before each time, and total; strata below the minimum are dropped."""
    own = Window.partitionBy("kind", "key")
    later = own.orderBy("time").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    return times.withColumn("total", F.sum("m").over(own)).where(F.col("total") >= minimum).withColumn("n", F.sum("m").over(later))


def survival_points(times: DataFrame, minimum: int = MIN_SAMPLE) -> DataFrame:
    """The same curve as rows, by a running product from left to right: for strata of any number of days, without a fold in one row."""
    own = Window.partitionBy("kind", "key").orderBy("time").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    risk = at_risk(times, minimum)
    d, n = F.col("d").cast("double"), F.col("n").cast("double")
    s = F.product(1 - d / n).over(own)
    v = F.sum(F.when((d > 0) & (n > d), d / (n * (n - d))).otherwise(0.0)).over(own)
    rows = risk.withColumn("survival", s).withColumn("half", 1.96 * F.sqrt(F.greatest(F.lit(0.0), s * s * v))).withColumn("hazard", d / n)
    return rows.select("kind", "key", "time", "n", "d", "total", "survival", clamp(F.col("survival") - F.col("half")).alias("low"), clamp(F.col("survival") + F.col("half")).alias("high"), "hazard")


POINTS_SQL = (
    DUR_SQL
    + """, lab AS (SELECT duration AS time, event, unnest([{'kind': 'national', 'key': 'all'}, {'kind': 'court', 'key': CAST(court_id AS VARCHAR)}, {'kind': 'court_case_type', 'key': court_id || '|' || case_type}, {'kind': 'state', 'key': state},
      {'kind': 'state_case_type', 'key': state || '|' || case_type}, {'kind': 'case_type', 'key': case_type}, {'kind': 'judge', 'key': coalesce(CAST(judge_id AS VARCHAR), 'unknown')}]) AS s FROM dur),
    tm AS (SELECT s.kind AS kind, s.key AS key, time, CAST(sum(event) AS BIGINT) AS d, count(*) AS m FROM lab GROUP BY ALL),
    rk AS (SELECT *, CAST(sum(m) OVER (PARTITION BY kind, key) AS BIGINT) AS total, CAST(sum(m) OVER (PARTITION BY kind, key ORDER BY time ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS n FROM tm),
    km AS (SELECT *, product(1 - d / n) OVER w AS survival, sum(CASE WHEN d > 0 AND n > d THEN d / (n * (n - d)) ELSE 0 END) OVER w AS v, d / n AS hazard FROM rk WHERE total >= 25 WINDOW w AS (PARTITION BY kind, key ORDER BY time ROWS UNBOUNDED PRECEDING))"""
)


@query("sur_2_kaplan_meier", POINTS_SQL + " SELECT kind, key, time, n, d, round(survival, 8) AS survival, round(least(1, greatest(0, survival - 1.96 * sqrt(survival * survival * v))), 8) AS low, round(least(1, greatest(0, survival + 1.96 * sqrt(survival * survival * v))), 8) AS high FROM km")
def kaplan_meier(t: Tables) -> DataFrame:
    p = survival_points(strata(durations(t)))
    return p.select("kind", "key", "time", "n", "d", *[F.round(c, 8).alias(c) for c in ("survival", "low", "high")])


@query("sur_3_hazard", POINTS_SQL + " SELECT kind, key, time, round(hazard, 8) AS hazard FROM km")
def hazard(t: Tables) -> DataFrame:
    return survival_points(strata(durations(t))).select("kind", "key", "time", F.round("hazard", 8).alias("hazard"))


@query("sur_4_smoothed_hazard", POINTS_SQL + " SELECT kind, key, time, round(sum(hazard) OVER (PARTITION BY kind, key ORDER BY time ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) / 7, 8) AS smoothed FROM km")
def smoothed_hazard(t: Tables, width: int = SMOOTHING) -> DataFrame:
    """A centred mean with zeros beyond the ends: the sum over the window, by its full width."""
    around = Window.partitionBy("kind", "key").orderBy("time").rowsBetween(-(width // 2), width // 2)
    return survival_points(strata(durations(t))).select("kind", "key", "time", F.round(F.sum("hazard").over(around) / width, 8).alias("smoothed"))


@query(
    "sur_5_stratified",
    POINTS_SQL
    + """ SELECT kind, key, any_value(total) AS total, CAST(sum(d) AS BIGINT) AS events, min(time) FILTER (round(survival, 10) <= 0.5) AS median, min(time) FILTER (round(survival, 10) <= 0.25) AS q75 FROM km GROUP BY ALL""",
)
def stratified(t: Tables) -> DataFrame:
    first = lambda level: F.min(F.when(F.round("survival", 10) <= level, F.col("time")))
    return survival_points(strata(durations(t))).groupBy("kind", "key").agg(F.max("total").alias("total"), F.sum("d").alias("events"), first(0.5).alias("median"), first(0.25).alias("q75"))


LEVELS = ("court_case_type", "court", "state_case_type", "national")
#: Fewest cases of a stratum from which a curve is used for prediction.
ENOUGH = 100


def _label(keys) -> Column:
    return F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("unknown")) for k in keys]) if keys else F.lit("all")


def with_stratum(t: Tables, levels=LEVELS, minimum: int = ENOUGH, every: bool = False) -> tuple[DataFrame, DataFrame]:
    """Open cases with the kind and key of the finest stratum that has a curve, and the points of the curves.

    With every, closed cases come too, and the age is a case's duration up to its end.

    A stratum is looked up by its label alone, one small row for each; no curve is carried to a case.
    """
    rows = durations(t, judges=False)
    points = survival_points(strata(rows, tuple(s for s in STRATA if s[0] in levels)), minimum)
    known = points.select("kind", "key").distinct()
    asked = rows.withColumn("age", F.col("duration")) if every else rows.where("event = 0")
    out = asked.select("case_id", "court_id", "state", "case_type", "age")
    for kind in levels:
        own = known.where(F.col("kind") == kind).select(F.col("key").alias(f"key_{kind}"))
        out = out.join(own, _label(dict(STRATA)[kind]) == F.col(f"key_{kind}"), "left")
    best = F.coalesce(*[F.when(F.col(f"key_{k}").isNotNull(), F.struct(F.lit(k).alias("kind"), F.col(f"key_{k}").alias("key"))) for k in levels])
    return out.select("case_id", "age", best.alias("s")).select("case_id", "age", "s.kind", "s.key"), points


def spans(points: DataFrame) -> DataFrame:
    """Each point with the next one and the area under the curve beyond that; a first row at -1 has survival 1."""
    own = Window.partitionBy("kind", "key").orderBy("time")
    first = points.groupBy("kind", "key").agg(F.lit(-1).cast("long").alias("time"), F.lit(1.0).alias("survival"))
    steps = points.select("kind", "key", "time", "survival").unionByName(first)
    steps = steps.withColumn("next_time", F.lead("time").over(own)).withColumn("next_survival", F.lead("survival").over(own))
    # Areas by trapezoids between points of the curve; the row at -1 is none.
    area = F.when(F.col("time") >= 0, (F.col("next_time") - F.col("time")) * (F.col("survival") + F.col("next_survival")) / 2)
    beyond = F.coalesce(F.sum(area).over(own.rowsBetween(1, Window.unboundedFollowing)), F.lit(0.0))
    return steps.withColumn("beyond", beyond)


def at_ages(asked: DataFrame, points: DataFrame) -> DataFrame:
    """The last row of spans at or before each distinct (kind, key, age) of asked.

    An as-of join: ages are laid between the points of their curve, and each takes the last point before it. Ages are
    whole days, so that a stratum of any number of cases is a few thousand rows.
    """
    values = F.struct("time", "survival", "next_time", "next_survival", "beyond")
    steps = spans(points).select("kind", "key", F.col("time").alias("at"), F.lit(0).alias("asked"), values.alias("v"))
    ages = asked.select("kind", "key", "age").distinct().select("kind", "key", F.col("age").alias("at"), F.lit(1).alias("asked"), F.lit(None).cast(steps.schema["v"].dataType).alias("v"))
    before = Window.partitionBy("kind", "key").orderBy("at", "asked").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = steps.unionByName(ages).withColumn("v", F.last("v", ignorenulls=True).over(before)).where("asked = 1")
    return found.select("kind", "key", F.col("at").alias("age"), "v.*")


@query(
    "sur_7_step_lookup",
    POINTS_SQL
    + """, dk AS (SELECT DISTINCT kind, key FROM km), dy AS (SELECT kind, key, unnest(range(0, 3601, 90)) AS day FROM dk)
    SELECT dy.kind, dy.key, dy.day, round(coalesce(k.survival, 1), 8) AS survival FROM dy ASOF LEFT JOIN km k ON dy.kind = k.kind AND dy.key = k.key AND dy.day >= k.time""",
)
def step_lookup(t: Tables, step: int = 90, last: int = 3600) -> DataFrame:
    """Each curve's survival on days at even steps: that of its last point up to the day, 1 before the first point."""
    points = survival_points(strata(durations(t)))
    days = F.transform(F.sequence(F.lit(0), F.lit(last), F.lit(step)), lambda d: d.cast("long"))
    asked = points.select("kind", "key").distinct().select("kind", "key", F.explode(days).alias("age"))
    return at_ages(asked, points).select("kind", "key", F.col("age").alias("day"), F.round("survival", 8).alias("survival"))


def predicted(t: Tables, horizon: int = HORIZON) -> DataFrame:
    """case_id, kind, s_age, s_horizon and days_left of open cases, read off the curve of their stratum."""
    cases, points = with_stratum(t)
    ages = cases.select("kind", "key", "age").distinct()
    now = at_ages(ages, points)
    later = at_ages(ages.select("kind", "key", (F.col("age") + horizon).alias("age")), points)
    left = F.when(F.col("next_time").isNull(), 0.0).otherwise((F.col("next_time") - F.col("age")) * (F.col("survival") + F.col("next_survival")) / 2 + F.col("beyond"))
    read = now.select("kind", "key", "age", F.col("survival").alias("s_age"), left.alias("days_left"))
    read = read.join(later.select("kind", "key", (F.col("age") - horizon).alias("age"), F.col("survival").alias("s_horizon")), ["kind", "key", "age"])
    return cases.join(read, ["kind", "key", "age"]).select("case_id", "kind", "s_age", "s_horizon", "days_left")


PREDICT_SQL = (
    POINTS_SQL.replace("total >= 25", "total >= 100")
    + """, op AS (SELECT case_id, age, unnest([{'kind': 'court_case_type', 'key': court_id || '|' || case_type, 'depth': 0}, {'kind': 'court', 'key': CAST(court_id AS VARCHAR), 'depth': 1}, {'kind': 'state_case_type', 'key': state || '|' || case_type, 'depth': 2}, {'kind': 'national', 'key': 'all', 'depth': 3}]) AS s FROM dur WHERE event = 0),
    ks AS (SELECT DISTINCT kind, key FROM km),
    ch AS (SELECT op.case_id, op.age, ks.kind, ks.key FROM op JOIN ks ON ks.kind = op.s.kind AND ks.key = op.s.key QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY op.s.depth) = 1),
    s1 AS (SELECT ch.*, coalesce(k.survival, 1) AS s_age FROM ch ASOF LEFT JOIN km k ON ch.kind = k.kind AND ch.key = k.key AND ch.age >= k.time),
    s2 AS (SELECT s1.*, coalesce(k.survival, 1) AS s_five FROM s1 ASOF LEFT JOIN km k ON s1.kind = k.kind AND s1.key = k.key AND s1.age + 1825 >= k.time)"""
)


@query("sur_6_curve_fallback", PREDICT_SQL + " SELECT case_id, kind FROM ch")
def curve_fallback(t: Tables) -> DataFrame:
    return with_stratum(t)[0].select("case_id", "kind")


@query("sur_8_prediction", PREDICT_SQL + " SELECT case_id, round(s_age, 4) AS s_age, round(s_five, 4) AS s_five, round((1 - s_age) * 100, 2) AS percentile, round((1 - s_age) * 100, 6) >= 90 AS unusual FROM s2")
def prediction(t: Tables, threshold: float = 90) -> DataFrame:
    passed = (1 - F.col("s_age")) * 100
    return predicted(t).select("case_id", F.round("s_age", 4).alias("s_age"), F.round("s_horizon", 4).alias("s_five"), F.round(passed, 2).alias("percentile"), (F.round(passed, 6) >= threshold).alias("unusual"))


@query(
    "sur_9_remaining",
    PREDICT_SQL
    + """, tz AS (SELECT *, lead(time) OVER w AS nt, lead(survival) OVER w AS ns FROM km WINDOW w AS (PARTITION BY kind, key ORDER BY time)),
    ar AS (SELECT s2.case_id, s2.age, s2.s_age, min(k.time) AS t1, arg_min(k.survival, k.time) AS s1, coalesce(sum((nt - k.time) * (k.survival + ns) / 2), 0) AS rest FROM s2 LEFT JOIN tz k ON s2.kind = k.kind AND s2.key = k.key AND k.time > s2.age GROUP BY ALL)
    SELECT case_id, round(CASE WHEN t1 IS NULL THEN 0 ELSE (t1 - age) * (s_age + s1) / 2 + rest END, 2) AS days_left FROM ar""",
)
def remaining(t: Tables) -> DataFrame:
    """Expected days left: the area by trapezoids under the curve after a case's age."""
    return predicted(t).select("case_id", F.round("days_left", 2).alias("days_left"))


@query(
    "sur_10_endpoint",
    POINTS_SQL
    + """, k AS (SELECT DISTINCT kind, key FROM km), y AS (SELECT kind, key, years FROM k, (VALUES (1), (2), (5), (10)) v(years)), s AS (SELECT y.kind, y.key, y.years, coalesce(m.survival, 1) AS s FROM y ASOF LEFT JOIN km m ON y.kind = m.kind AND y.key = m.key AND y.years * 365 >= m.time)
    SELECT kind, key, round(max(s) FILTER (years = 1), 4) AS y1, round(max(s) FILTER (years = 2), 4) AS y2, round(max(s) FILTER (years = 5), 4) AS y5, round(max(s) FILTER (years = 10), 4) AS y10, round(1 - max(s) FILTER (years = 10), 4) AS incidence FROM s GROUP BY ALL""",
)
def endpoint(t: Tables) -> DataFrame:
    """Survival at whole years by a conditional aggregate over the points: the last one not beyond the year."""
    p = survival_points(strata(durations(t)))
    at = lambda years: F.coalesce(F.max_by(F.when(F.col("time") <= 365 * years, F.col("survival")), F.when(F.col("time") <= 365 * years, F.col("time"))), F.lit(1.0))
    return p.groupBy("kind", "key").agg(*[F.round(at(y), 4).alias(f"y{y}") for y in (1, 2, 5, 10)], F.round(1 - at(10), 4).alias("incidence"))


@query(
    "sur_11_confidence",
    POINTS_SQL
    + """, w AS (SELECT kind, key, any_value(total) AS n, sum(d) AS e, avg(least(1, greatest(0, survival + 1.96 * sqrt(survival * survival * v))) - least(1, greatest(0, survival - 1.96 * sqrt(survival * survival * v)))) AS width FROM km GROUP BY ALL)
    SELECT kind, key, round(least(1, 0.45 * least(1, n / 300) + 0.30 * least(1, (e / n) / 0.6) + 0.25 * greatest(0.1, 1 - least(1, width))), 4) AS confidence FROM w""",
)
def curve_confidence(t: Tables) -> DataFrame:
    w = survival_points(strata(durations(t))).groupBy("kind", "key").agg(F.max("total").alias("n"), F.sum("d").alias("e"), F.avg(F.col("high") - F.col("low")).alias("width"))
    one = F.lit(1.0)
    c = 0.45 * F.least(one, F.col("n") / 300) + 0.30 * F.least(one, F.col("e") / F.col("n") / 0.6) + 0.25 * F.greatest(F.lit(0.1), 1 - F.least(one, F.col("width")))
    return w.select("kind", "key", F.round(clamp(c), 4).alias("confidence"))


@query("sur_12_flags", PREDICT_SQL + " SELECT case_id, round(s_age, 4) AS s_age FROM s2 WHERE round((1 - s_age) * 100, 6) >= 90 OR round(s_age, 8) < 0.10")
def flags(t: Tables) -> DataFrame:
    return predicted(t).where((F.round((1 - F.col("s_age")) * 100, 6) >= 90) | (F.round("s_age", 8) < 0.10)).select("case_id", F.round("s_age", 4).alias("s_age"))


ALL_CASES_SQL = PREDICT_SQL.replace("total >= 100", "total >= 25").replace("SELECT case_id, age, unnest(", "SELECT case_id, duration AS age, unnest(").replace(" FROM dur WHERE event = 0", " FROM dur")
ALL_CASES_SQL = ALL_CASES_SQL.replace("{'kind': 'national', 'key': 'all', 'depth': 3}", "{'kind': 'state', 'key': state, 'depth': 3}, {'kind': 'case_type', 'key': case_type, 'depth': 4}, {'kind': 'national', 'key': 'all', 'depth': 5}")
#: The finest curve first: those of a case's court and type, court, state and type, state, type, and all.
CASE_LEVELS = ("court_case_type", "court", "state_case_type", "state", "case_type", "national")


@query(
    "inv_2_survival",
    ALL_CASES_SQL + ", sz AS (SELECT kind, key, any_value(total) AS sample FROM km GROUP BY ALL) SELECT case_id, s2.kind AS grouping, sample, round(s_age, 6) AS survival, round(s_five, 6) AS later, round((1 - s_age) * 100, 2) AS percentile, round((1 - s_age) * 100, 2) >= 90 AS unusual FROM s2 JOIN sz ON s2.kind = sz.kind AND s2.key = sz.key",
)
def case_survival(t: Tables, horizon: int = HORIZON, threshold: float = 90, least: int = 25) -> DataFrame:
    """Survival at each case's duration and a horizon later, open or closed, by the finest curve there is, with its sample and whether that is unusual."""
    cases, points = with_stratum(t, CASE_LEVELS, least, every=True)
    ages = cases.select("kind", "key", "age").distinct()
    now = at_ages(ages, points).select("kind", "key", "age", F.col("survival").alias("s"))
    later = at_ages(ages.select("kind", "key", (F.col("age") + horizon).alias("age")), points).select("kind", "key", (F.col("age") - horizon).alias("age"), F.col("survival").alias("after"))
    samples = points.groupBy("kind", "key").agg(F.max("total").alias("sample"))
    read = now.join(later, ["kind", "key", "age"]).join(samples, ["kind", "key"])
    rank = F.round((1 - F.col("s")) * 100, 2)
    return cases.join(read, ["kind", "key", "age"]).select("case_id", F.col("kind").alias("grouping"), "sample", F.round("s", 6).alias("survival"), F.round("after", 6).alias("later"), rank.alias("percentile"), (rank >= threshold).alias("unusual"))
