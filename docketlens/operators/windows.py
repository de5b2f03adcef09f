"""Ordered analytics (WIN), lists with filters and paging (FIL, SRT) and projections (PRJ)."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docketlens.operators.advocates import GAPS_SQL, gaps, hearing_order
from docketlens.plans.registry import query
from docketlens.sources.domain import Tables

ORDERED_SQL = ", o AS (SELECT *, row_number() OVER w AS rn, count(*) OVER (PARTITION BY case_id) AS n, lag(judge_id) OVER w AS before FROM hearings WINDOW w AS (PARTITION BY case_id ORDER BY date, line, part, judge_id, price))"


def ordered(hearings: DataFrame) -> DataFrame:
    w = hearing_order()
    return hearings.withColumn("rn", F.row_number().over(w)).withColumn("before", F.lag("judge_id").over(w)).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("case_id")))


@query("win_2_gaps", GAPS_SQL + " SELECT case_id, count(gap) AS gaps, CAST(sum(gap) AS BIGINT) AS total, max(gap) AS longest FROM gaps GROUP BY 1")
def gap_summary(t: Tables) -> DataFrame:
    return gaps(t.hearings).groupBy("case_id").agg(F.count("gap").alias("gaps"), F.sum("gap").alias("total"), F.max("gap").alias("longest"))


@query(
    "win_3_worsening",
    """, g AS (SELECT case_id, date_diff('day', lag(date) OVER w, date) AS gap, row_number() OVER (PARTITION BY case_id ORDER BY date DESC, line DESC, part DESC, judge_id DESC, price DESC) AS back, count(*) OVER (PARTITION BY case_id) AS n FROM hearings WINDOW w AS (PARTITION BY case_id ORDER BY date, line, part, judge_id, price))
    SELECT case_id, coalesce(any_value(n) >= 4 AND max(CASE WHEN back = 1 THEN gap END) > max(CASE WHEN back = 2 THEN gap END) AND max(CASE WHEN back = 2 THEN gap END) > max(CASE WHEN back = 3 THEN gap END), false) AS worsening FROM g GROUP BY 1""",
)
def worsening(t: Tables) -> DataFrame:
    """At least four hearings, and the last three gaps grow."""
    w = hearing_order()
    g = gaps(t.hearings).withColumn("g1", F.lag("gap").over(w)).withColumn("g2", F.lag("gap", 2).over(w)).withColumn("at", F.struct("date", "line", "part", "judge_id", "price"))
    grows = (F.col("gap") > F.col("g1")) & (F.col("g1") > F.col("g2"))
    return g.groupBy("case_id").agg((F.coalesce(F.max_by(grows, "at"), F.lit(False)) & (F.count(F.lit(1)) >= 4)).alias("worsening"))


def halves_trend(hearings: DataFrame, margin: float = 0.15) -> DataFrame:
    """The share of adjournments in the later half of at least three hearings against the earlier half."""
    adjourned = (F.col("outcome_type") == "ADJOURNED").cast("double")
    early = F.col("rn") <= F.floor(F.col("n") / 2)
    shares = ordered(hearings).where("n >= 3").groupBy("case_id").agg(F.avg(F.when(~early, adjourned)).alias("late"), F.avg(F.when(early, adjourned)).alias("early"))
    change = F.col("late") - F.col("early")
    return shares.select("case_id", F.when(change > margin, "increasing").when(change < -margin, "decreasing").otherwise("stable").alias("trend"))


@query(
    "win_4_halves",
    ORDERED_SQL
    + """, h AS (SELECT case_id, avg(CASE WHEN rn > n // 2 THEN CAST(outcome_type = 'ADJOURNED' AS INT) END) - avg(CASE WHEN rn <= n // 2 THEN CAST(outcome_type = 'ADJOURNED' AS INT) END) AS c FROM o WHERE n >= 3 GROUP BY 1)
    SELECT case_id, CASE WHEN c > 0.15 THEN 'increasing' WHEN c < -0.15 THEN 'decreasing' ELSE 'stable' END AS trend FROM h""",
)
def trend_by_halves(t: Tables) -> DataFrame:
    return halves_trend(t.hearings)


@query("win_5_judge_changes", ORDERED_SQL + " SELECT case_id, count(*) FILTER (rn > 1 AND judge_id IS DISTINCT FROM before) AS changes FROM o GROUP BY 1")
def judge_changes(t: Tables) -> DataFrame:
    return ordered(t.hearings).groupBy("case_id").agg(F.count_if((F.col("rn") > 1) & ~F.col("judge_id").eqNullSafe(F.col("before"))).alias("changes"))


@query(
    "win_6_change_events",
    """, e AS (SELECT case_id, date, CASE WHEN line <> 3 THEN judge_id END AS judge, line, part, judge_id, price FROM hearings),
    p AS (SELECT *, last_value(judge IGNORE NULLS) OVER (PARTITION BY case_id ORDER BY date, line, part, judge_id, price ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS old FROM e)
    SELECT case_id, date, old AS old_judge, judge AS new_judge FROM p WHERE judge IS NOT NULL AND old IS NOT NULL AND judge <> old""",
)
def change_events(t: Tables) -> DataFrame:
    """Changes against the last judge that is known; in every third line of a case none is recorded."""
    known = t.hearings.withColumn("judge", F.when(F.col("line") != 3, F.col("judge_id")))
    old = F.last("judge", ignorenulls=True).over(hearing_order().rowsBetween(Window.unboundedPreceding, -1))
    return known.withColumn("old_judge", old).where("judge <> old_judge").select("case_id", "date", "old_judge", F.col("judge").alias("new_judge"))


@query(
    "win_7_accelerating",
    """, g AS (SELECT case_id, date_diff('day', lag(date) OVER w, date) AS gap, row_number() OVER w AS rn FROM hearings WINDOW w AS (PARTITION BY case_id ORDER BY date, line, part, judge_id, price)),
    k AS (SELECT case_id, gap, row_number() OVER (PARTITION BY case_id ORDER BY rn) - 1 AS i, count(*) OVER (PARTITION BY case_id) AS n FROM g WHERE gap IS NOT NULL)
    SELECT case_id, avg(CASE WHEN i > n // 2 THEN gap END) < 0.7 * avg(CASE WHEN i <= n // 2 THEN gap END) AS accelerating FROM k WHERE n >= 2 GROUP BY 1""",
)
def accelerating(t: Tables) -> DataFrame:
    g = gaps(t.hearings).withColumn("i", F.row_number().over(hearing_order()) - 2).withColumn("n", F.count("gap").over(Window.partitionBy("case_id"))).where("gap IS NOT NULL AND n >= 2")
    first = F.col("i") <= F.floor(F.col("n") / 2)
    return g.groupBy("case_id").agg((F.avg(F.when(~first, F.col("gap"))) < 0.7 * F.avg(F.when(first, F.col("gap")))).alias("accelerating"))


RUNS_SQL = ", runs AS (SELECT event_type AS source, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY ALL)"


def daily_runs(t: Tables) -> DataFrame:
    return t.read("events").groupBy(F.col("event_type").alias("source"), F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))


@query("win_8_rolling_median", RUNS_SQL + " SELECT source, day, n, median(n) OVER (PARTITION BY source ORDER BY day ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS median_before FROM runs")
def rolling_median(t: Tables, last: int = 10) -> DataFrame:
    frame = Window.partitionBy("source").orderBy("day").rowsBetween(-last, -1)
    return daily_runs(t).withColumn("median_before", F.percentile("n", F.lit(0.5)).over(frame))


@query("win_11_weighted_median", """, x AS (SELECT court_id, date_diff('day', filing_date, DATE '2001-12-31') AS v, pow(0.5, date_diff('day', filing_date, DATE '2001-12-31') / 730.0) AS w FROM cases WHERE is_disposed),
    g AS (SELECT court_id, v, sum(w) AS w FROM x GROUP BY ALL), c AS (SELECT court_id, v, sum(w) OVER (PARTITION BY court_id ORDER BY v) AS cum, sum(w) OVER (PARTITION BY court_id) AS total FROM g)
    SELECT court_id, min(v) AS weighted_median FROM c WHERE cum >= total / 2 GROUP BY 1""")
def weighted_median(t: Tables, half_life: int = 730) -> DataFrame:
    """Ages by court, weighted by their half-life; equal ages are summed before the running total."""
    age = F.datediff(t.as_of, "filing_date").cast("long")
    g = t.cases.where("is_disposed").select("court_id", age.alias("v")).groupBy("court_id", "v").agg(F.sum(F.pow(F.lit(0.5), F.col("v") / half_life)).alias("w"))
    cum = F.sum("w").over(Window.partitionBy("court_id").orderBy("v"))
    return g.withColumn("cum", cum).withColumn("total", F.sum("w").over(Window.partitionBy("court_id"))).where("cum >= total / 2").groupBy("court_id").agg(F.min("v").alias("weighted_median"))


@query("win_13_latest_run", RUNS_SQL + " SELECT source, max(day) AS day, arg_max(n, day) AS n FROM runs GROUP BY 1")
def latest_run(t: Tables) -> DataFrame:
    return daily_runs(t).groupBy("source").agg(F.max("day").alias("day"), F.max_by("n", "day").alias("n"))


def filter_cases(cases: DataFrame, court: str | None = None, state: str | None = None, case_type: str | None = None, filed_from: str | None = None, filed_to: str | None = None, min_importance: float | None = None, party: str | None = None) -> DataFrame:
    """Any of the filters that are given, all of them to hold."""
    for column, text in (("court", court), ("state", state), ("case_type", case_type), ("party_name", party)):
        if text is not None:
            cases = cases.where(F.col(column).ilike(f"%{text}%"))
    if filed_from is not None:
        cases = cases.where(F.col("filing_date") >= filed_from)
    if filed_to is not None:
        cases = cases.where(F.col("filing_date") <= filed_to)
    return cases if min_importance is None else cases.where(F.col("importance") >= min_importance)


@query("fil_1_case_filters", "SELECT case_id, court, state, case_type, filing_date FROM cases WHERE state ILIKE '%asia%' AND case_type ILIKE '%build%' AND filing_date BETWEEN DATE '1997-01-01' AND DATE '1999-12-31' AND importance >= 0.5")
def case_filters(t: Tables) -> DataFrame:
    return filter_cases(t.cases, state="asia", case_type="build", filed_from="1997-01-01", filed_to="1999-12-31", min_importance=0.5).select("case_id", "court", "state", "case_type", "filing_date")


@query("fil_2_export_filters", "SELECT case_id, status, importance FROM cases WHERE state = 'EUROPE' AND status = 'pending' AND importance IS NOT NULL AND importance >= 0.25")
def export_filters(t: Tables) -> DataFrame:
    return t.cases.where("state = 'EUROPE' AND status = 'pending' AND importance IS NOT NULL AND importance >= 0.25").select("case_id", "status", "importance")


@query("fil_4_investigation_search", "SELECT case_id, importance, date_diff('day', filing_date, DATE '2001-12-31') AS days FROM cases ORDER BY importance DESC NULLS LAST, days DESC NULLS LAST, case_id LIMIT 50 OFFSET 100")
def investigation_search(t: Tables, page: int = 3, size: int = 50) -> DataFrame:
    days = F.datediff(t.as_of, "filing_date").cast("long").alias("days")
    return t.cases.select("case_id", "importance", days).orderBy(F.desc_nulls_last("importance"), F.desc_nulls_last("days"), "case_id").offset((page - 1) * size).limit(size)


@query("fil_5_review_queue", "SELECT case_id, date, line, outcome_type, confidence FROM hearings WHERE confidence IS NULL OR confidence < 0.3 OR outcome_type = 'NOT_REACHED'")
def review_queue(t: Tables, threshold: float = 0.3) -> DataFrame:
    c = F.col("confidence")
    return t.hearings.where(c.isNull() | (c < threshold) | (F.col("outcome_type") == "NOT_REACHED")).select("case_id", "date", "line", "outcome_type", "confidence").orderBy(F.desc("date"), F.desc("case_id"))


@query("fil_6_stale_parser", "SELECT case_id, date, line, part FROM hearings WHERE linestatus <> 'F' OR confidence < 0.1 ORDER BY date, case_id, line, part, price LIMIT 200")
def stale_parser(t: Tables, limit: int = 200) -> DataFrame:
    """Oldest first; a top-k, which Spark keeps as one heap per task."""
    return t.hearings.where("linestatus IS NULL OR linestatus <> 'F' OR confidence < 0.1").orderBy("date", "case_id", "line", "part", "price").limit(limit).select("case_id", "date", "line", "part")


@query("fil_7_incremental", "SELECT case_id FROM case_spans WHERE last_hearing IS NULL OR last_hearing > DATE '2001-01-01'")
def incremental(t: Tables) -> DataFrame:
    return t.case_spans.where("last_hearing IS NULL OR last_hearing > DATE '2001-01-01'").select("case_id")


@query("fil_14_rate_limit", "SELECT event_id, count(*) OVER (PARTITION BY user_id, event_type ORDER BY ts RANGE BETWEEN INTERVAL 30 DAY PRECEDING AND INTERVAL 1 SECOND PRECEDING) >= 3 AS rejected FROM events")
def rate_limit(t: Tables, days: int = 30, most: int = 3) -> DataFrame:
    second = 1_000_000
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    before = Window.partitionBy("user_id", "event_type").orderBy(at).rangeBetween(-days * 86400 * second, -second)
    return t.read("events").select("event_id", (F.count(F.lit(1)).over(before) >= most).alias("rejected"))


@query("srt_1_page", "SELECT case_id, court, count(*) OVER () AS total FROM cases ORDER BY case_id LIMIT 20 OFFSET 40")
def page(t: Tables, number: int = 3, size: int = 20) -> DataFrame:
    total = t.cases.agg(F.count(F.lit(1)).alias("total"))
    return t.cases.select("case_id", "court").orderBy("case_id").offset((number - 1) * size).limit(size).join(total, F.lit(True))


@query("srt_2_nulls_last", "SELECT case_id, importance, amount FROM cases ORDER BY importance DESC NULLS LAST, amount DESC NULLS LAST, case_id LIMIT 100")
def nulls_last(t: Tables) -> DataFrame:
    return t.cases.select("case_id", "importance", "amount").orderBy(F.desc_nulls_last("importance"), F.desc_nulls_last("amount"), "case_id").limit(100)


@query("srt_7_top10_judges", "SELECT court_id, judge_id, n FROM (SELECT court_id, judge_id, count(*) AS n FROM hearings JOIN cases USING (case_id) GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY court_id ORDER BY n DESC, judge_id) <= 10")
def top10_judges(t: Tables, k: int = 10) -> DataFrame:
    counts = t.hearings.select("case_id", "judge_id").join(t.cases.select("case_id", "court_id"), "case_id").groupBy("court_id", "judge_id").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy("court_id").orderBy(F.desc("n"), "judge_id"))
    return counts.withColumn("rn", rank).where(F.col("rn") <= k).drop("rn")


@query("prj_2_case_export", "SELECT case_id, court, state, case_type, status, filing_date FROM cases")
def case_export(t: Tables) -> DataFrame:
    return t.cases.select("case_id", "court", "state", "case_type", "status", "filing_date")


@query(
    "prj_3_headlines",
    """, r AS (SELECT case_id, importance, date_diff('day', filing_date, DATE '2001-12-31') / 1000 AS ratio FROM cases)
    SELECT case_id, concat_ws('; ', CASE WHEN ratio >= 2 THEN 'far slower than similar cases' WHEN ratio >= 1.2 THEN 'slower than similar cases' ELSE 'in line with similar cases' END,
    CASE WHEN importance >= 0.75 THEN 'high importance' WHEN importance >= 0.45 THEN 'medium importance' END) AS headline FROM r""",
)
def headlines(t: Tables) -> DataFrame:
    ratio, importance = F.datediff(t.as_of, "filing_date") / 1000, F.col("importance")
    pace = F.when(ratio >= 2, "far slower than similar cases").when(ratio >= 1.2, "slower than similar cases").otherwise("in line with similar cases")
    weight = F.when(importance >= 0.75, "high importance").when(importance >= 0.45, "medium importance")
    return t.cases.select("case_id", F.concat_ws("; ", pace, weight).alias("headline"))


@query("prj_6_durations", "SELECT case_id, CAST(d // 365 AS BIGINT) AS years, CAST(d % 365 // 30 AS BIGINT) AS months, CAST(d // 365 AS VARCHAR) || 'y ' || CAST(d % 365 // 30 AS VARCHAR) || 'm' AS text FROM (SELECT case_id, date_diff('day', filing_date, DATE '2001-12-31') AS d FROM cases)")
def durations(t: Tables) -> DataFrame:
    d = F.datediff(t.as_of, "filing_date")
    years, months = F.floor(d / 365), F.floor(d % 365 / 30)
    return t.cases.select("case_id", years.alias("years"), months.alias("months"), F.format_string("%dy %dm", years, months).alias("text"))


@query("prj_7_backfill", "SELECT case_id, CAST(coalesce(year(filing_date), 0) AS INTEGER) AS filing_year FROM cases")
def backfill(t: Tables) -> DataFrame:
    return t.cases.select("case_id", F.coalesce(F.year("filing_date"), F.lit(0)).alias("filing_year"))
