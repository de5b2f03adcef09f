"""Advocate views (AGG-22 to 26), the court snapshot (AGG-27) and the joins they stand on (JOIN)."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docketlens.plans.registry import query
from docketlens.sources.domain import Tables

COUNSEL_SQL = ", counsel AS (SELECT DISTINCT case_id, judge_id AS advocate_id FROM hearings)"


def counsel(t: Tables) -> DataFrame:
    return t.hearings.select("case_id", F.col("judge_id").alias("advocate_id")).distinct()


def percent(part, whole, digits: int = 1):
    return F.round(F.try_divide(100 * part, whole), digits)


@query(
    "agg_22_portfolio",
    COUNSEL_SQL
    + """ SELECT advocate_id, court_level, case_type, state, count(*) AS cases, round(avg(date_diff('day', filing_date, coalesce(last_hearing, filing_date))), 4) AS avg_days,
    count(*) FILTER (is_disposed) AS disposed, round(100 * count(*) FILTER (is_disposed) / count(*), 1) AS disposed_pct FROM counsel JOIN case_spans USING (case_id) GROUP BY ALL""",
)
def portfolio(t: Tables) -> DataFrame:
    """counsel is distinct, so that plain counts replace counts of distinct cases."""
    joined = counsel(t).join(t.case_spans, "case_id")
    n, d = F.count(F.lit(1)), F.count_if("is_disposed")
    days = F.datediff(F.coalesce("last_hearing", "filing_date"), "filing_date")
    return joined.groupBy("advocate_id", "court_level", "case_type", "state").agg(n.alias("cases"), F.round(F.avg(days), 4).alias("avg_days"), d.alias("disposed"), percent(d, n).alias("disposed_pct"))


def events_of_advocates(t: Tables) -> DataFrame:
    """An adjournment is an advocate's if they asked for it or are counsel in the case: two equi-joins and a distinct union, in place of a join on OR."""
    columns = ["advocate_id", "case_id", "date", "line", "part", "requested_by", "reason_type", "was_contested"]
    by_case = counsel(t).join(t.adjournments, "case_id").select(columns)
    by_request = t.adjournments.where("requested_by IS NOT NULL").withColumn("advocate_id", F.col("requested_by")).select(columns)
    return by_case.union(by_request).distinct()


@query(
    "join_4_events_or_none",
    COUNSEL_SQL
    + """, ev AS (SELECT DISTINCT s_suppkey AS advocate_id, case_id, date, line, part, reason_type FROM supplier, adjournments a WHERE requested_by = s_suppkey OR EXISTS (SELECT 1 FROM counsel c WHERE c.advocate_id = s_suppkey AND c.case_id = a.case_id))
    SELECT s_suppkey AS advocate_id, case_id, date, line, part, reason_type FROM supplier LEFT JOIN ev ON advocate_id = s_suppkey""",
)
def events_or_none(t: Tables) -> DataFrame:
    """Every advocate with each adjournment that they asked for or that falls in a case of theirs, or with none."""
    keys = ["advocate_id", "case_id", "date", "line", "part", "reason_type"]
    advocates = t.read("supplier").select(F.col("s_suppkey").alias("advocate_id"))
    return advocates.join(events_of_advocates(t).select(keys).distinct(), "advocate_id", "left").select(keys)


@query(
    "agg_23_adjournments",
    COUNSEL_SQL
    + """, p AS (SELECT advocate_id, case_id, date, line, part, requested_by, reason_type, was_contested FROM counsel JOIN adjournments USING (case_id)
      UNION SELECT requested_by, case_id, date, line, part, requested_by, reason_type, was_contested FROM adjournments WHERE requested_by IS NOT NULL)
    SELECT advocate_id, count(DISTINCT case_id) AS cases, count(*) AS events, count(*) FILTER (requested_by = advocate_id) AS requested, count(*) FILTER (reason_type = 'on_request') AS on_request,
    count(*) FILTER (was_contested) AS contested, round(100 * count(*) FILTER (requested_by = advocate_id) / count(*), 1) AS requested_pct FROM p GROUP BY 1""",
)
def adjournment_view(t: Tables) -> DataFrame:
    events = events_of_advocates(t)
    n, asked = F.count(F.lit(1)), F.count_if(F.col("requested_by") == F.col("advocate_id"))
    by_pair = events.groupBy("advocate_id", "case_id").agg(n.alias("n"), asked.alias("asked"), F.count_if(F.col("reason_type") == "on_request").alias("on_request"), F.count_if("was_contested").alias("contested"))
    out = by_pair.groupBy("advocate_id").agg(F.count(F.lit(1)).alias("cases"), F.sum("n").alias("events"), F.sum("asked").alias("requested"), F.sum("on_request").alias("on_request"), F.sum("contested").alias("contested"))
    return out.withColumn("requested_pct", percent(F.col("requested"), F.col("events")))


@query(
    "agg_24_applications",
    """SELECT advocate_id, application_type, count(*) AS filed, count(*) FILTER (decision_status = 'granted') AS granted, count(*) FILTER (decision_status = 'rejected') AS rejected, count(*) FILTER (decision_status = 'dismissed') AS dismissed,
    round(100 * count(*) FILTER (decision_status = 'granted') / count(*), 1) AS granted_pct, round(100 * count(*) FILTER (is_frivolous) / count(*), 1) AS frivolous_pct, round(coalesce(avg(delay_days), 0), 4) AS avg_delay, CAST(coalesce(sum(delay_days), 0) AS BIGINT) AS total_delay
    FROM applications WHERE application_type IS NOT NULL GROUP BY ALL""",
)
def application_view(t: Tables) -> DataFrame:
    n = F.count(F.lit(1))
    of = lambda s: F.count_if(F.col("decision_status") == s)
    return (
        t.applications.where("application_type IS NOT NULL")
        .groupBy("advocate_id", "application_type")
        .agg(n.alias("filed"), of("granted").alias("granted"), of("rejected").alias("rejected"), of("dismissed").alias("dismissed"), percent(of("granted"), n).alias("granted_pct"), percent(F.count_if("is_frivolous"), n).alias("frivolous_pct"), F.round(F.coalesce(F.avg("delay_days"), F.lit(0.0)), 4).alias("avg_delay"), F.coalesce(F.sum("delay_days"), F.lit(0)).alias("total_delay"))
    )


@query(
    "agg_25_specialization",
    COUNSEL_SQL
    + """, c AS (SELECT advocate_id, court_id, count(*) AS cases, count(*) FILTER (NOT is_disposed) AS active FROM counsel JOIN cases USING (case_id) GROUP BY ALL)
    SELECT *, round(100 * active / cases, 1) AS active_pct, rank() OVER (PARTITION BY court_id ORDER BY cases DESC) AS rank_in_court FROM c""",
)
def specialization(t: Tables) -> DataFrame:
    c = counsel(t).join(t.cases.select("case_id", "court_id", "is_disposed"), "case_id").groupBy("advocate_id", "court_id").agg(F.count(F.lit(1)).alias("cases"), F.count_if(~F.col("is_disposed")).alias("active"))
    rank = F.rank().over(Window.partitionBy("court_id").orderBy(F.desc("cases"))).cast("long")
    return c.withColumn("active_pct", percent(F.col("active"), F.col("cases"))).withColumn("rank_in_court", rank)


@query("win_1_top3_by_court", COUNSEL_SQL + ", c AS (SELECT advocate_id, court_id, count(*) AS cases FROM counsel JOIN cases USING (case_id) GROUP BY ALL) SELECT *, rank() OVER (PARTITION BY court_id ORDER BY cases DESC) AS r FROM c QUALIFY r <= 3")
def top_by_court(t: Tables, k: int = 3) -> DataFrame:
    c = counsel(t).join(t.cases.select("case_id", "court_id"), "case_id").groupBy("advocate_id", "court_id").agg(F.count(F.lit(1)).alias("cases"))
    return c.withColumn("r", F.rank().over(Window.partitionBy("court_id").orderBy(F.desc("cases"))).cast("long")).where(F.col("r") <= k)


@query(
    "agg_26_performance",
    COUNSEL_SQL
    + """, c AS (SELECT advocate_id, count(*) AS cases, count(*) FILTER (is_disposed) AS disposed, count(DISTINCT court_id) AS courts, round(avg(date_diff('day', filing_date, coalesce(last_hearing, filing_date))), 4) AS avg_days FROM counsel JOIN case_spans USING (case_id) GROUP BY 1),
    j AS (SELECT requested_by AS advocate_id, count(*) AS requested FROM adjournments WHERE requested_by IS NOT NULL GROUP BY 1),
    a AS (SELECT advocate_id, count(*) AS filed, count(*) FILTER (is_frivolous) AS frivolous FROM applications GROUP BY 1)
    SELECT advocate_id, cases, disposed, courts, avg_days, coalesce(requested, 0) AS requested, coalesce(filed, 0) AS filed, coalesce(frivolous, 0) AS frivolous FROM c LEFT JOIN j USING (advocate_id) LEFT JOIN a USING (advocate_id)""",
)
def performance(t: Tables) -> DataFrame:
    """Each branch is aggregated before the join, so that averages are over cases and not over their fan-out."""
    c = (
        counsel(t)
        .join(t.case_spans, "case_id")
        .groupBy("advocate_id")
        .agg(F.count(F.lit(1)).alias("cases"), F.count_if("is_disposed").alias("disposed"), F.count_distinct("court_id").alias("courts"), F.round(F.avg(F.datediff(F.coalesce("last_hearing", "filing_date"), "filing_date")), 4).alias("avg_days"))
    )
    j = t.adjournments.where("requested_by IS NOT NULL").groupBy(F.col("requested_by").alias("advocate_id")).agg(F.count(F.lit(1)).alias("requested"))
    a = t.applications.groupBy("advocate_id").agg(F.count(F.lit(1)).alias("filed"), F.count_if("is_frivolous").alias("frivolous"))
    return c.join(j, "advocate_id", "left").join(a, "advocate_id", "left").fillna(0, ["requested", "filed", "frivolous"])


GAPS_SQL = ", gaps AS (SELECT case_id, date_diff('day', lag(date) OVER (PARTITION BY case_id ORDER BY date, line, part, judge_id, price), date) AS gap FROM hearings)"


def hearing_order():
    return Window.partitionBy("case_id").orderBy("date", "line", "part", "judge_id", "price")


def gaps(hearings: DataFrame) -> DataFrame:
    """Days from each hearing of a case to the next one; the first one has none."""
    return hearings.withColumn("gap", F.datediff("date", F.lag("date").over(hearing_order())).cast("long"))


@query(
    "agg_27_court_snapshot",
    GAPS_SQL
    + """, g AS (SELECT case_id, quantile_cont(gap, 0.5) AS med FROM gaps WHERE gap IS NOT NULL GROUP BY 1),
    r AS (SELECT court_id, n_adjourned / n_hearings AS rate, med FROM case_spans LEFT JOIN g USING (case_id) WHERE n_hearings > 0)
    SELECT court_id, count(*) AS cases, round(avg(rate), 6) AS mean_rate, round(coalesce(stddev_samp(rate), 0), 6) AS std_rate, median(med) AS median_gap FROM r GROUP BY 1""",
)
def court_snapshot(t: Tables) -> DataFrame:
    """Two levels: rate and median gap of each case, then their mean, deviation and median by court."""
    g = gaps(t.hearings).where("gap IS NOT NULL").groupBy("case_id").agg(F.percentile("gap", 0.5).alias("med"))
    r = t.case_spans.where("n_hearings > 0").join(g, "case_id", "left").select("court_id", (F.col("n_adjourned") / F.col("n_hearings")).alias("rate"), "med")
    return r.groupBy("court_id").agg(F.count(F.lit(1)).alias("cases"), F.round(F.avg("rate"), 6).alias("mean_rate"), F.round(F.coalesce(F.stddev_samp("rate"), F.lit(0.0)), 6).alias("std_rate"), F.median("med").alias("median_gap"))


@query("join_2_semi", "SELECT case_id, court FROM cases c WHERE EXISTS (SELECT 1 FROM adjournments a WHERE a.case_id = c.case_id AND was_contested)")
def flagged_cases(t: Tables) -> DataFrame:
    return t.cases.select("case_id", "court").join(t.adjournments.where("was_contested"), "case_id", "left_semi")


@query("join_6_hearings_of_filtered", "SELECT count(*) AS n, count(DISTINCT case_id) AS cases FROM hearings WHERE case_id IN (SELECT case_id FROM cases WHERE state = 'ASIA' AND status = 'pending')")
def hearings_of_filtered(t: Tables) -> DataFrame:
    wanted = t.cases.where("state = 'ASIA' AND status = 'pending'").select("case_id")
    return t.hearings.join(wanted, "case_id", "left_semi").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("case_id").alias("cases"))


@query("join_9_backlog", "SELECT case_id, count(*) OVER (PARTITION BY court_id ORDER BY filing_date RANGE BETWEEN INTERVAL 90 DAY PRECEDING AND CURRENT ROW) AS backlog FROM cases")
def filing_backlog(t: Tables, days: int = 90) -> DataFrame:
    """Cases that the court took in during the days before each filing: counts by day first, so that the window is over days."""
    by_day = t.cases.groupBy("court_id", "filing_date").agg(F.count(F.lit(1)).alias("n"))
    frame = Window.partitionBy("court_id").orderBy(F.unix_date("filing_date")).rangeBetween(-days, 0)
    return t.cases.select("case_id", "court_id", "filing_date").join(by_day.withColumn("backlog", F.sum("n").over(frame)), ["court_id", "filing_date"]).select("case_id", "backlog")


@query("join_10_latest_judge", "SELECT case_id, max(date) AS date, arg_max(judge_id, (date, line, part, judge_id, price)) AS judge_id FROM hearings GROUP BY 1")
def latest_judge(t: Tables) -> DataFrame:
    return t.hearings.groupBy("case_id").agg(F.max("date").alias("date"), F.max_by("judge_id", F.struct("date", "line", "part", "judge_id", "price")).alias("judge_id"))


@query("join_15_same_day", "SELECT h.case_id, h.date, count(*) AS n FROM hearings h JOIN orders o ON h.case_id = o.o_orderkey AND h.date = CAST(o.o_orderdate AS DATE) GROUP BY ALL")
def same_day(t: Tables) -> DataFrame:
    filed = t.read("orders").select(F.col("o_orderkey").alias("case_id"), F.to_date("o_orderdate").alias("date"))
    return t.hearings.join(filed, ["case_id", "date"]).groupBy("case_id", "date").agg(F.count(F.lit(1)).alias("n"))


@query("join_17_anti", "SELECT case_id FROM cases WHERE case_id NOT IN (SELECT case_id FROM hearings)")
def unheard_cases(t: Tables) -> DataFrame:
    return t.cases.select("case_id").join(t.hearings, "case_id", "left_anti")


@query("join_18_legacy_ids", "SELECT s_suppkey AS judge_id, md5('legacy-judge:' || s_suppkey) AS registry_id FROM supplier WHERE NOT EXISTS (SELECT 1 FROM hearings h WHERE h.judge_id = s_suppkey AND h.date < DATE '1995-01-04')")
def legacy_ids(t: Tables) -> DataFrame:
    judges = t.read("supplier").select(F.col("s_suppkey").alias("judge_id"))
    old = t.hearings.where(F.col("date") < "1995-01-04").select("judge_id")
    return judges.join(old, "judge_id", "left_anti").select("judge_id", F.md5(F.concat(F.lit("legacy-judge:"), F.col("judge_id").cast("string"))).alias("registry_id"))
