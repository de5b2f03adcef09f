"""Published data sets beyond cases and hearings: flagged cases and coverage (PRJ-1)."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketlens.operators import delay, dormancy, survival
from docketlens.operators.feed_stats import REPORTS_SQL, reports
from docketlens.plans.registry import query
from docketlens.sources.domain import Tables

#: Each kind of flag with the SQL that finds it.
_FLAGS = (
    ("baseline_delay_anomaly", delay.CHOSEN_SQL + " SELECT case_id, round(ratio, 4) AS score FROM norm WHERE ratio >= 1.5 OR pct >= 90 OR z >= 2"),
    ("dormant_case", dormancy.SCORE_SQL + " SELECT case_id, round(CAST(score AS DOUBLE), 4) AS score FROM fin WHERE candidate AND score >= 0.45"),
    ("survival_delay_anomaly", survival.PREDICT_SQL + " SELECT case_id, round(s_age, 4) AS score FROM s2 WHERE round((1 - s_age) * 100, 6) >= 90 OR round(s_age, 8) < 0.10"),
)


@query(
    "prj_1_flagged_export",
    "SELECT f.* FROM (" + " UNION ALL ".join(f"SELECT case_id, '{name}' AS flag_type, CAST(score AS DOUBLE) AS score FROM (WITH {sql.lstrip().removeprefix(',')})" for name, sql in _FLAGS) + ") f SEMI JOIN (SELECT case_id FROM cases WHERE state = 'ASIA') USING (case_id)",
)
def flagged_export(t: Tables, state: str = "ASIA") -> DataFrame:
    """The active flags of the cases that a filter picks, whatever found them: a semi join on each branch."""
    picked = t.cases.where(F.col("state") == state).select("case_id")
    found = delay.flags(t).unionByName(dormancy.flags(t).select("case_id", F.lit("dormant_case").alias("flag_type"), F.round("score", 4).alias("score")))
    found = found.unionByName(survival.flags(t).select("case_id", F.lit("survival_delay_anomaly").alias("flag_type"), F.col("s_age").alias("score")))
    return found.join(picked, "case_id", "left_semi").select("case_id", "flag_type", F.col("score").cast("double").alias("score"))


@query("prj_1_coverage_export", REPORTS_SQL + " SELECT article_id AS mention_id, case_id, source AS source_name, published AS published_at, cred AS credibility_score FROM rep SEMI JOIN (SELECT case_id FROM cases WHERE state = 'ASIA') USING (case_id)")
def coverage_export(t: Tables, state: str = "ASIA") -> DataFrame:
    """What is reported of the cases that a filter picks."""
    picked = t.cases.where(F.col("state") == state).select("case_id")
    return reports(t).join(picked, "case_id", "left_semi").select(F.col("article_id").alias("mention_id"), "case_id", F.col("source").alias("source_name"), F.col("published").alias("published_at"), F.col("credibility").alias("credibility_score"))
