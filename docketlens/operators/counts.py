"""Counts, shares and summaries over cases, hearings and courts (AGG), and the lists drawn from them (FIL, SRT)."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docketlens.plans.registry import query
from docketlens.sources.domain import Tables


def counted(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def with_share(counts: DataFrame, digits: int = 2) -> DataFrame:
    """A share in percent of all rows; the window runs over one row per group, not over the input."""
    total = F.sum("n").over(Window.partitionBy(F.lit(1)))
    return counts.withColumn("percent", F.round(F.col("n") * 100 / total, digits))


def disposal_counts(cases: DataFrame, *keys: str) -> DataFrame:
    total, disposed = F.count(F.lit(1)), F.count_if("is_disposed")
    return cases.groupBy(*keys).agg(total.alias("total"), disposed.alias("disposed"), (total - disposed).alias("pending"))


@query("agg_1_case_count", "SELECT count(*) AS n FROM cases")
def case_count(t: Tables) -> DataFrame:
    return t.cases.agg(F.count(F.lit(1)).alias("n"))


@query("agg_2_by_court", "SELECT court_id, court, count(*) AS n FROM cases GROUP BY ALL")
def by_court(t: Tables) -> DataFrame:
    return counted(t.cases, "court_id", "court").orderBy(F.desc("n"), "court_id")


@query("agg_3_by_state", "SELECT state, count(*) AS n FROM cases WHERE state IS NOT NULL GROUP BY ALL")
def by_state(t: Tables) -> DataFrame:
    return counted(t.cases.where("state IS NOT NULL"), "state").orderBy(F.desc("n"), "state")


@query("agg_4_by_type", "SELECT case_type, count(*) AS n FROM cases WHERE case_type IS NOT NULL GROUP BY ALL")
def by_type(t: Tables) -> DataFrame:
    return counted(t.cases.where("case_type IS NOT NULL"), "case_type").orderBy(F.desc("n"), "case_type")


@query("agg_5_status_distribution", "SELECT status, count(*) AS n, round(count(*) * 100 / sum(count(*)) OVER (), 2) AS percent FROM cases WHERE status IS NOT NULL GROUP BY 1")
def status_distribution(t: Tables) -> DataFrame:
    return with_share(counted(t.cases.where("status IS NOT NULL"), "status"))


@query("agg_6_pending_disposed", "SELECT count(*) AS total, count(*) FILTER (is_disposed) AS disposed, count(*) FILTER (NOT is_disposed) AS pending FROM cases")
def pending_disposed(t: Tables) -> DataFrame:
    return disposal_counts(t.cases)


def filings_by_month(cases: DataFrame, as_of, months: int = 12) -> DataFrame:
    recent = cases.where(F.col("filing_date") >= F.date_sub(as_of, 30 * months))
    return counted(recent.withColumn("month", F.date_format("filing_date", "yyyy-MM")), "month")


MONTHS_SQL = "SELECT strftime(filing_date, '%Y-%m') AS month, count(*) AS n FROM cases WHERE filing_date >= DATE '2001-12-31' - 360 GROUP BY 1"


@query("agg_7_by_month", MONTHS_SQL)
def by_month(t: Tables) -> DataFrame:
    return filings_by_month(t.cases, t.as_of)


@query("agg_8_in_range", "SELECT count(*) AS n FROM cases WHERE filing_date BETWEEN DATE '1996-01-01' AND DATE '1996-12-31'")
def in_range(t: Tables) -> DataFrame:
    return t.cases.where(F.col("filing_date").between("1996-01-01", "1996-12-31")).agg(F.count(F.lit(1)).alias("n"))


@query("agg_9_court_type_matrix", "SELECT court, case_type, count(*) AS n FROM cases GROUP BY ALL")
def court_type_matrix(t: Tables) -> DataFrame:
    return counted(t.cases, "court", "case_type")


@query(
    "agg_10_state_type_pivot",
    """SELECT state, count(*) FILTER (case_type = 'automobile') AS automobile, count(*) FILTER (case_type = 'building') AS building, count(*) FILTER (case_type = 'furniture') AS furniture,
    count(*) FILTER (case_type = 'household') AS household, count(*) FILTER (case_type = 'machinery') AS machinery FROM cases GROUP BY 1""",
)
def state_type_pivot(t: Tables) -> DataFrame:
    kinds = ["automobile", "building", "furniture", "household", "machinery"]
    return t.cases.groupBy("state").pivot("case_type", kinds).agg(F.count(F.lit(1))).fillna(0, kinds)


@query(
    "agg_11_summary",
    """SELECT count(*) AS total, count(*) FILTER (is_disposed) AS disposed, count(DISTINCT court_id) AS courts, count(DISTINCT case_type) AS types,
    (SELECT court FROM cases GROUP BY court ORDER BY count(*) DESC, court LIMIT 1) AS top_court,
    (SELECT case_type FROM cases GROUP BY case_type ORDER BY count(*) DESC, case_type LIMIT 1) AS top_type FROM cases""",
)
def summary(t: Tables) -> DataFrame:
    """All figures from one pass: counts by court and type are few rows, and everything else follows from them."""
    by = t.cases.groupBy("court_id", "court", "case_type").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_disposed").alias("d"))
    courts = by.groupBy("court").agg(F.sum("n").alias("n"), F.sum("d").alias("d")).agg(F.sum("n").alias("total"), F.sum("d").alias("disposed"), F.count(F.lit(1)).alias("courts"), F.min(F.struct(-F.col("n"), "court"))["court"].alias("top_court"))
    types = by.groupBy("case_type").agg(F.sum("n").alias("n")).agg(F.count(F.lit(1)).alias("types"), F.min(F.struct(-F.col("n"), "case_type"))["case_type"].alias("top_type"))
    return courts.join(types, F.lit(True)).select("total", "disposed", "courts", "types", "top_court", "top_type")


@query("agg_12_court_performance", "SELECT court, count(*) AS total, count(*) FILTER (is_disposed) AS disposed, count(*) FILTER (NOT is_disposed) AS pending, round(count(*) FILTER (is_disposed) * 100 / count(*), 2) AS rate FROM cases GROUP BY 1")
def court_performance(t: Tables) -> DataFrame:
    counts = disposal_counts(t.cases, "court")
    return counts.withColumn("rate", F.round(F.col("disposed") * 100 / F.col("total"), 2)).orderBy(F.desc("rate"), "court")


@query(
    "agg_13_trend",
    f""", m AS ({MONTHS_SQL}) SELECT count(*) AS months, CAST(sum(n) AS BIGINT) AS total, round(avg(n), 2) AS average,
    (SELECT month FROM m ORDER BY n DESC, month LIMIT 1) AS peak, (SELECT month FROM m ORDER BY n, month LIMIT 1) AS lowest FROM m""",
)
def trend(t: Tables) -> DataFrame:
    m = filings_by_month(t.cases, t.as_of)
    return m.agg(F.count(F.lit(1)).alias("months"), F.sum("n").alias("total"), F.round(F.avg("n"), 2).alias("average"), F.min(F.struct(-F.col("n"), "month"))["month"].alias("peak"), F.min(F.struct("n", "month"))["month"].alias("lowest"))


@query("agg_14_outcomes", "SELECT outcome_type, count(*) AS n, round(count(*) * 100 / sum(count(*)) OVER (), 2) AS percent FROM hearings GROUP BY 1")
def outcomes(t: Tables) -> DataFrame:
    return with_share(counted(t.hearings, "outcome_type"))


@query("agg_15_adjournment_rate", "SELECT count(*) AS hearings, count(*) FILTER (outcome_type = 'ADJOURNED') AS adjourned, round(count(*) FILTER (outcome_type = 'ADJOURNED') * 100 / count(*), 2) AS rate FROM hearings")
def adjournment_rate(t: Tables) -> DataFrame:
    n, a = F.count(F.lit(1)), F.count_if(F.col("outcome_type") == "ADJOURNED")
    return t.hearings.agg(n.alias("hearings"), a.alias("adjourned"), F.round(F.try_divide(a * 100, n), 2).alias("rate"))


@query("agg_16_backlog", "SELECT court_id, count(*) AS total, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'disposed') AS disposed, round(count(*) FILTER (status = 'pending') / count(*), 4) AS ratio FROM cases GROUP BY 1")
def backlog(t: Tables) -> DataFrame:
    n, p = F.count(F.lit(1)), F.count_if(F.col("status") == "pending")
    return t.cases.groupBy("court_id").agg(n.alias("total"), p.alias("pending"), F.count_if(F.col("status") == "disposed").alias("disposed"), F.round(p / n, 4).alias("ratio"))


@query("agg_17_court_stats", "SELECT court_id, count(*) AS total, count(*) FILTER (NOT coalesce(is_disposed, false)) AS pending FROM cases GROUP BY 1")
def court_stats(t: Tables) -> DataFrame:
    return t.cases.groupBy("court_id").agg(F.count(F.lit(1)).alias("total"), F.count_if(~F.coalesce("is_disposed", F.lit(False))).alias("pending"))


@query("agg_18_state_metrics", "SELECT state, count(*) AS total, count(*) FILTER (NOT is_disposed) AS pending, round(avg(coalesce(importance, 0)), 6) AS avg_importance FROM cases GROUP BY 1")
def state_metrics(t: Tables) -> DataFrame:
    return t.cases.groupBy("state").agg(F.count(F.lit(1)).alias("total"), F.count_if(~F.col("is_disposed")).alias("pending"), F.round(F.avg(F.coalesce("importance", F.lit(0.0))), 6).alias("avg_importance"))


@query("agg_19_type_metrics", "SELECT coalesce(case_type, 'unknown') AS case_type, count(*) AS total, round(avg(coalesce(importance, 0)), 6) AS avg_importance FROM cases GROUP BY 1")
def type_metrics(t: Tables) -> DataFrame:
    return t.cases.groupBy(F.coalesce("case_type", F.lit("unknown")).alias("case_type")).agg(F.count(F.lit(1)).alias("total"), F.round(F.avg(F.coalesce("importance", F.lit(0.0))), 6).alias("avg_importance"))


@query("agg_20_judge_stats", "SELECT judge_id, count(*) AS hearings, round(avg(coalesce(confidence, 0)), 6) AS avg_confidence FROM hearings WHERE judge_id IS NOT NULL GROUP BY 1")
def judge_stats(t: Tables) -> DataFrame:
    return t.hearings.where("judge_id IS NOT NULL").groupBy("judge_id").agg(F.count(F.lit(1)).alias("hearings"), F.round(F.avg(F.coalesce("confidence", F.lit(0.0))), 6).alias("avg_confidence"))


@query(
    "agg_21_judge_live",
    """, c AS (SELECT DISTINCT judge_id, case_id FROM hearings), d AS (SELECT judge_id, median(date_diff('day', filing_date, last_hearing)) AS m FROM c JOIN case_spans USING (case_id) WHERE is_disposed AND last_hearing IS NOT NULL GROUP BY 1)
    SELECT judge_id, count(*) AS hearings, round(count(*) FILTER (outcome_type = 'ADJOURNED') / count(*), 4) AS rate, any_value(m) AS median_days FROM hearings LEFT JOIN d USING (judge_id) GROUP BY 1""",
)
def judge_live(t: Tables) -> DataFrame:
    """The median runs over the distinct cases of a judge, not over hearings."""
    n = F.count(F.lit(1))
    rates = t.hearings.groupBy("judge_id").agg(n.alias("hearings"), F.round(F.count_if(F.col("outcome_type") == "ADJOURNED") / n, 4).alias("rate"))
    closed = t.case_spans.where("is_disposed AND last_hearing IS NOT NULL").select("case_id", F.datediff("last_hearing", "filing_date").alias("days"))
    days = t.hearings.select("judge_id", "case_id").distinct().join(closed, "case_id").groupBy("judge_id").agg(F.median("days").alias("median_days"))
    return rates.join(days, "judge_id", "left")


#: Upper ends of the delay bins.
DELAY_BINS = ((0.5, "0-0.5"), (1.0, "0.5-1"), (2.0, "1-2"), (3.0, "2-3"))


@query(
    "agg_28_delay_distribution",
    """, r AS (SELECT state, case_type, date_diff('day', filing_date, DATE '2001-12-31') / 1000 AS ratio FROM cases WHERE filing_date IS NOT NULL),
    b AS (SELECT state, case_type, CASE WHEN ratio < 0.5 THEN '0-0.5' WHEN ratio < 1 THEN '0.5-1' WHEN ratio < 2 THEN '1-2' WHEN ratio < 3 THEN '2-3' ELSE '3+' END AS bin, count(*) AS n FROM r GROUP BY ALL)
    SELECT *, round(n / sum(n) OVER (PARTITION BY state, case_type), 4) AS coverage FROM b""",
)
def delay_distribution(t: Tables, unit: int = 1000) -> DataFrame:
    """Ratio of age to a unit of days, in five bins for each state and type; empty bins have no row."""
    ratio = F.datediff(t.as_of, "filing_date") / unit
    label = F.when(ratio < DELAY_BINS[0][0], DELAY_BINS[0][1])
    for upper, name in DELAY_BINS[1:]:
        label = label.when(ratio < upper, name)
    counts = counted(t.cases.where("filing_date IS NOT NULL").withColumn("bin", label.otherwise("3+")), "state", "case_type", "bin")
    return counts.withColumn("coverage", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("state", "case_type")), 4))


@query(
    "agg_29_derived",
    "SELECT state, court_level, count(*) FILTER (status LIKE 'pending%') AS pending, round(coalesce(avg(importance), 0), 6) AS avg_importance, round(count(*) FILTER (importance >= 0.7) / count(*), 4) AS high_share FROM cases GROUP BY ALL",
)
def derived(t: Tables) -> DataFrame:
    n = F.count(F.lit(1))
    return t.cases.groupBy("state", "court_level").agg(F.count_if(F.col("status").startswith("pending")).alias("pending"), F.round(F.coalesce(F.avg("importance"), F.lit(0.0)), 6).alias("avg_importance"), F.round(F.count_if(F.col("importance") >= 0.7) / n, 4).alias("high_share"))


@query("agg_30_court_export", "SELECT court, state, count(*) AS total, count(*) FILTER (status ILIKE '%pending%') AS pending, count(*) FILTER (status ILIKE '%disposed%') AS disposed FROM cases GROUP BY ALL")
def court_export(t: Tables) -> DataFrame:
    return t.cases.groupBy("court", "state").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("status").ilike("%pending%")).alias("pending"), F.count_if(F.col("status").ilike("%disposed%")).alias("disposed"))


@query("agg_31_judge_export", "SELECT judge_id, count(*) AS hearings, round(avg(confidence), 6) AS avg_confidence FROM hearings WHERE judge_id IS NOT NULL GROUP BY 1")
def judge_export(t: Tables) -> DataFrame:
    return t.hearings.where("judge_id IS NOT NULL").groupBy("judge_id").agg(F.count(F.lit(1)).alias("hearings"), F.round(F.avg("confidence"), 6).alias("avg_confidence")).orderBy(F.desc("hearings"), "judge_id")


@query("agg_32_case_rates", "SELECT case_id, n_hearings, n_adjourned, round(CASE WHEN n_hearings = 0 THEN 0 ELSE n_adjourned / n_hearings END, 4) AS rate FROM case_spans")
def case_rates(t: Tables) -> DataFrame:
    rate = F.coalesce(F.try_divide("n_adjourned", "n_hearings"), F.lit(0.0))
    return t.case_spans.select("case_id", "n_hearings", "n_adjourned", F.round(rate, 4).alias("rate"))


@query(
    "agg_33_court_anomaly",
    """, r AS (SELECT case_id, court_id, n_adjourned / n_hearings AS rate FROM case_spans WHERE n_hearings > 0), s AS (SELECT court_id, avg(rate) AS m, coalesce(stddev_samp(rate), 0) AS sd FROM r GROUP BY 1)
    SELECT court_id, count(*) AS n, count(*) FILTER (rate > m + 2 * sd) AS unusual FROM r JOIN s USING (court_id) GROUP BY 1""",
)
def court_anomaly(t: Tables) -> DataFrame:
    """Cases whose rate is beyond mean and two deviations of their court."""
    r = t.case_spans.where("n_hearings > 0").select("court_id", (F.col("n_adjourned") / F.col("n_hearings")).alias("rate"))
    s = r.groupBy("court_id").agg(F.avg("rate").alias("m"), F.coalesce(F.stddev_samp("rate"), F.lit(0.0)).alias("sd"))
    return r.join(s, "court_id").groupBy("court_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("rate") > F.col("m") + 2 * F.col("sd")).alias("unusual"))


@query(
    "agg_36_data_quality",
    """SELECT count(*) AS n, round(1 - sum(CAST(importance IS NULL AS INT) + CAST(next_hearing_date IS NULL AS INT) + CAST(status IS NULL OR status = '' AS INT)) / (count(*) * 3), 6) AS completeness,
    round(coalesce(avg(importance), 0.75), 6) AS confidence FROM cases""",
)
def data_quality(t: Tables) -> DataFrame:
    missing = [F.col("importance").isNull(), F.col("next_hearing_date").isNull(), F.col("status").isNull() | (F.col("status") == "")]
    gaps = sum((m.cast("int") for m in missing[1:]), missing[0].cast("int"))
    return t.cases.agg(F.count(F.lit(1)).alias("n"), F.round(1 - F.sum(gaps) / (F.count(F.lit(1)) * len(missing)), 6).alias("completeness"), F.round(F.coalesce(F.avg("importance"), F.lit(0.75)), 6).alias("confidence"))


@query(
    "agg_39_run_rollup",
    """, r AS (SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n, count(*) FILTER (value < 5) AS failed FROM events GROUP BY ALL)
    SELECT day, count(*) AS runs, CAST(sum(n) AS BIGINT) AS records, count(*) FILTER (failed > 0.12 * n) AS bad,
    CASE WHEN count(*) FILTER (failed > 0.12 * n) = 0 THEN 'SUCCESS' WHEN count(*) FILTER (failed > 0.12 * n) < count(*) THEN 'PARTIAL' ELSE 'FAILED' END AS status FROM r GROUP BY 1""",
)
def run_rollup(t: Tables) -> DataFrame:
    runs = t.read("events").groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") < 5).alias("failed"))
    total, bad = F.count(F.lit(1)), F.count_if(F.col("failed") > 0.12 * F.col("n"))
    status = F.when(F.col("bad") == 0, "SUCCESS").when(F.col("bad") < F.col("runs"), "PARTIAL").otherwise("FAILED")
    return runs.groupBy("day").agg(total.alias("runs"), F.sum("n").alias("records"), bad.alias("bad")).withColumn("status", status)


@query("agg_40_dashboard", "SELECT count(*) AS cases, count(DISTINCT court_id) AS courts, (SELECT count(*) FROM hearings) AS hearings, (SELECT count(DISTINCT judge_id) FROM hearings) AS judges FROM cases")
def dashboard(t: Tables) -> DataFrame:
    a = t.cases.agg(F.count(F.lit(1)).alias("cases"), F.count_distinct("court_id").alias("courts"))
    b = t.hearings.agg(F.count(F.lit(1)).alias("hearings"), F.count_distinct("judge_id").alias("judges"))
    return a.join(b, F.lit(True))


@query("agg_41_media_types", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def media_types(t: Tables) -> DataFrame:
    return counted(t.read("events"), "event_type")


@query("agg_42_bar_scale", "SELECT court, count(*) AS n, round(count(*) / max(count(*)) OVER (), 6) AS scale FROM cases GROUP BY 1")
def bar_scale(t: Tables) -> DataFrame:
    return counted(t.cases, "court").withColumn("scale", F.round(F.col("n") / F.max("n").over(Window.partitionBy(F.lit(1))), 6))


@query("agg_43_duration_percentiles", "SELECT coalesce(case_type, 'unknown') AS case_type, quantile_cont(coalesce(date_diff('day', filing_date, disposal_date), 0), 0.5) AS p50, quantile_cont(coalesce(date_diff('day', filing_date, disposal_date), 0), 0.9) AS p90 FROM case_spans GROUP BY 1")
def duration_percentiles(t: Tables) -> DataFrame:
    days = F.coalesce(F.datediff("disposal_date", "filing_date"), F.lit(0))
    p = t.case_spans.groupBy(F.coalesce("case_type", F.lit("unknown")).alias("case_type")).agg(F.percentile(days, [0.5, 0.9]).alias("p"))
    return p.select("case_type", F.col("p")[0].alias("p50"), F.col("p")[1].alias("p90"))


@query(
    "agg_44_outcome_alerts",
    """, r AS (SELECT *, row_number() OVER (PARTITION BY judge_id ORDER BY date DESC, case_id, line, part, price) AS rn FROM hearings)
    SELECT judge_id, round(avg(CAST(outcome_type = 'NOT_REACHED' AS INT)), 6) AS other_share, round(avg(CAST(coalesce(confidence, 0) < 0.6 AS INT)), 6) AS low_share, avg(CAST(outcome_type = 'NOT_REACHED' AS INT)) > 0.25 AS alert FROM r WHERE rn <= 200 GROUP BY 1""",
)
def outcome_alerts(t: Tables, last: int = 200, most: float = 0.25) -> DataFrame:
    """Shares over the last hearings of each judge. The last ones by key are a top-k, which Spark cuts before the window."""
    order = Window.partitionBy("judge_id").orderBy(F.desc("date"), "case_id", "line", "part", "price")
    recent = t.hearings.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= last)
    other = F.avg((F.col("outcome_type") == "NOT_REACHED").cast("int"))
    return recent.groupBy("judge_id").agg(F.round(other, 6).alias("other_share"), F.round(F.avg((F.coalesce("confidence", F.lit(0.0)) < 0.6).cast("int")), 6).alias("low_share"), (other > most).alias("alert"))


@query("agg_45_top_courts", "SELECT court, count(*) AS n FROM cases GROUP BY 1 ORDER BY n DESC, court LIMIT 5")
def top_courts(t: Tables, k: int = 5) -> DataFrame:
    return counted(t.cases, "court").orderBy(F.desc("n"), "court").limit(k)


#: Upper ends of the confidence histogram.
CONFIDENCE_BUCKETS = (0.1, 0.25, 0.5, 0.6, 0.75, 0.9, 0.95, 0.99, 1.0)


@query("agg_46_histogram", "SELECT " + ", ".join(f"count(*) FILTER (confidence <= {b}) AS le_{int(b * 100)}" for b in CONFIDENCE_BUCKETS) + ", count(*) AS n FROM hearings")
def histogram(t: Tables) -> DataFrame:
    """Cumulative buckets in one pass."""
    return t.hearings.agg(*[F.count_if(F.col("confidence") <= b).alias(f"le_{int(b * 100)}") for b in CONFIDENCE_BUCKETS], F.count(F.lit(1)).alias("n"))
