"""Literal expectations of single operators on hand-made rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from docketlens.operators import delay, dormancy, outcomes, provenance, quality, survival, tactics
from docketlens.sources.domain import Tables


def curve_of(spark, rows):
    df = spark.createDataFrame(rows, "duration long, event long")
    return survival.survival_points(survival.strata(df, (("national", ()),)), 1)


def test_kaplan_meier_of_four(spark):
    rows = curve_of(spark, [(1, 1), (2, 1), (3, 0), (4, 1)]).orderBy("time").collect()
    assert [r["survival"] for r in rows] == [0.75, 0.5, 0.5, 0.0]
    assert all(0 <= r["low"] <= r["survival"] <= r["high"] <= 1 for r in rows)
    assert [(r["n"], r["d"]) for r in rows] == [(4, 1), (3, 1), (2, 0), (1, 1)]


def test_step_function_and_remaining_days(spark):
    points = curve_of(spark, [(10, 1), (20, 1)])
    asked = spark.createDataFrame([("national", "all", a) for a in (0, 10, 15, 20, 99)] * 2, "kind string, key string, age long")
    at = {r["age"]: r for r in survival.at_ages(asked, points).collect()}
    assert {a: r["survival"] for a, r in at.items()} == {0: 1.0, 10: 0.5, 15: 0.5, 20: 0.0, 99: 0.0}
    first = at[0]  # 10 days from 1 to 0.5, then 10 days from 0.5 to 0
    assert (first["next_time"], first["next_survival"], first["beyond"]) == (10, 0.5, pytest.approx(2.5))


def test_extreme_delay(spark):
    df = spark.createDataFrame([(420, 100.0, 140.0, 180.0, 40.0)], "delay long, median double, p75 double, p90 double, iqr double")
    r = delay.normalised(df).withColumn("s", delay.severity(F.col("ratio"), F.col("pct"), F.col("z"))).first()
    assert r["ratio"] > 3 and r["s"] == "EXTREME_DELAY"


def test_disposed_delay(spark):
    df = spark.createDataFrame([(1, 1, "s", "Civil ", True, 0.5, dt.date(2020, 1, 1), dt.date(2021, 1, 1))], "case_id long, court_id int, state string, case_type string, is_disposed boolean, importance double, filing_date date, disposal_date date")
    r = delay.case_delays(df, F.lit("2026-01-01").cast("date")).first()
    assert (r["delay"], r["case_type"]) == (366, "civil")


@pytest.mark.parametrize(
    ("text", "outcome", "confidence"),
    [
        ("Matter adjourned to next week", "ADJOURNED", 0.95),
        ("Case postponed due to strike", "ADJOURNED", 0.95),
        ("Put up on 22.03.2026", "ADJOURNED", 0.95),
        ("Arguments heard", "HEARD", 0.92),
        ("Order reserved", "ORDER_RESERVED", 0.93),
        ("Dismissed with costs", "DISPOSED", 0.96),
        ("Not heard on account of paucity of time", "NOT_REACHED", 0.90),
        ("", "LISTED", 0.85),
        (None, "LISTED", 0.85),
        ("Matter mentioned", "OTHER", 0.35),
        ("matter adjourned", "OTHER", 0.35),  # only the whole word adjourn counts
        ("adj.04.05.2026", "ADJOURNED", 0.95),  # a dot counts where a letter or digit follows
        ("adj. for want of time", "OTHER", 0.35),
        ("adjd to 4 May", "ADJOURNED", 0.95),
        ("adjd.4", "ADJOURNED", 0.95),
        ("Relisted", "ADJOURNED", 0.95),
        ("taken up and considered", "HEARD", 0.92),
        ("matter not taken up", "NOT_REACHED", 0.90),
        ("Orders reserved", "ORDER_RESERVED", 0.93),
        ("Judgment pronounced", "DISPOSED", 0.96),
        ("No proceedings", "NO_PROCEEDINGS", 0.90),
        ("सुनवाई", "OTHER", 0.30),
    ],
)
def test_outcome_rules(spark, text, outcome, confidence):
    r = spark.createDataFrame([(text,)], "text string").select(outcomes.parsed(F.col("text")).alias("r")).first()["r"]
    assert (r["outcome"], r["confidence"]) == (outcome, confidence)


CASE = {"case_id": 1, "status": "pending", "case_type": "building", "days_substantive": 900, "days_listing": 400, "days": 400, "median": 180.0, "n_hearings": 3, "future_listing": False, "worsening": False, "data_confidence": 1.0, "importance": 0.8, "n_adjourned": 3, "stay_status": None, "recent_transfer": False}
CASE_TYPES = "case_id long, status string, case_type string, days_substantive long, days_listing long, days long, median double, n_hearings long, future_listing boolean, worsening boolean, data_confidence double, importance double, n_adjourned long, stay_status string, recent_transfer boolean"


@pytest.mark.parametrize(
    ("change", "excluded", "candidate", "score", "confidence"),
    [
        ({}, None, True, 0.45 * 5 / 6 + 0.35 * 900 / 1825 + 0.15 * 0.8, 1.0),
        ({"n_adjourned": 5, "worsening": True, "importance": 0.0}, None, True, 0.45 * 5 / 6 + 0.35 * 900 / 1825 + 0.14, 1.0),
        ({"n_hearings": 1, "data_confidence": 0.5}, None, True, 0.45 * 5 / 6 + 0.35 * 900 / 1825 + 0.15 * 0.8, 0.6),
        ({"days_substantive": 300}, None, False, 0.2 * 1.6667 / 6 + 0.2 * 300 / 1825 + 0.08, 1.0),
        ({"days_substantive": 0}, None, False, 0.2 * 400 / 1825 + 0.08, 1.0),  # 0 days count as missing, and any activity counts
        ({"days_substantive": None}, "no_baseline", False, 0.0, 1.0),
        ({"median": None}, "no_baseline", False, 0.0, 1.0),
        ({"status": "disposed"}, "not_pending", False, 0.0, 1.0),
        ({"stay_status": "granted"}, "active_stay", False, 0.0, 1.0),
        ({"stay_status": "vacated"}, None, True, 0.45 * 5 / 6 + 0.35 * 900 / 1825 + 0.15 * 0.8, 1.0),
        ({"future_listing": True, "days_listing": None}, "listed_soon", False, 0.0, 1.0),
        ({"future_listing": True}, None, False, 0.2 * 5 / 6 + 0.2 * 900 / 1825 + 0.08, 1.0),
        ({"recent_transfer": True}, "recent_transfer", False, 0.0, 1.0),
        ({"data_confidence": 0.25}, "low_confidence", False, 0.0, 0.25),
        ({"stay_status": "active", "recent_transfer": True}, "active_stay", False, 0.0, 1.0),
    ],
)
def test_dormancy_rules(spark, change, excluded, candidate, score, confidence):
    r = dormancy.judged(spark.createDataFrame([tuple((CASE | change).values())], CASE_TYPES)).first()
    assert (r["excluded"], bool(r["candidate"])) == (excluded, candidate)
    assert r["score"] == pytest.approx(score, abs=6e-5) and r["confidence"] == pytest.approx(confidence)


def of_hearings(spark, rows):
    """Tables with these hearings: (case, day, judge, outcome)."""
    t = Tables(spark, "")
    day = dt.date(2001, 1, 1)
    t.hearings = spark.createDataFrame([(c, day + dt.timedelta(days=d), j, o, 0.5, i, 1, 1.0, 0.0, 0.0, "O") for i, (c, d, j, o) in enumerate(rows)], "case_id long, date date, judge_id long, outcome_type string, confidence double, line int, part long, price double, discount double, tax double, linestatus string")
    return t


def test_bench_index(spark):
    """A judge counts as adjourning from three hearings on, and a case of one hearing scores 0."""
    rows = [(1, 0, 7, "HEARD")]
    rows += [(2, 0, 7, "ADJOURNED"), (2, 100, 7, "ADJOURNED")]
    rows += [(3, 0, 7, "ADJOURNED"), (3, 1, 7, "ADJOURNED"), (3, 2, 7, "HEARD"), (3, 731, 8, "HEARD")]
    got = {r["case_id"]: r["bench"] for r in tactics.bench_index(of_hearings(spark, rows)).collect()}
    years = 731 / 365.25
    assert got == {1: 0.0, 2: 0.175, 3: pytest.approx(0.4 * (1 / years) / 2 + 0.35 * 0.5 + 0.25 / 2, abs=5e-4)}


def test_rank_of_sources(spark):
    df = spark.createDataFrame([(0.5, "API", 0, "High COURT"), (0.5, "API", 0, "gazette"), (0.5, "FAX", 365, "court"), (1.0, "PDF", 30, None)], "c double, k string, a int, s string")
    got = [r[0] for r in df.select(provenance.rank_of(F.col("c"), F.col("k"), F.col("a"), F.col("s"))).collect()]
    assert got == pytest.approx([0.35 + 0.25 + 0.25 + 0.05, 0.35 + 0.25 + 0.25, 0.35 + 0.125 + 0.05, 0.7 + 0.23 + 0.25 - 30 / 365])


def test_alerts_of_a_day_double_their_wait():
    assert quality.waits() == [60, 120, 240, 480]


def test_percentile_table(spark):
    from docketlens.functions.numbers import step_lookup

    z = spark.createDataFrame([(-4.0,), (0.0,), (0.25,), (9.0,)], "z double").select(step_lookup(F.col("z"), tactics.Z_TABLE).alias("p"))
    assert [r["p"] for r in z.collect()] == pytest.approx([0.1, 50, 59.55, 99.9])


def test_tactic(spark):
    r = spark.createDataFrame([("Proxy counsel appearing",), ("",), (None,)], "text string").select(tactics.tactic(F.col("text")).alias("c")).collect()
    assert r[0]["c"]["tactic"] == "proxy_counsel" and r[0]["c"]["confidence"] == pytest.approx(0.75**0.65)
    assert [x["c"]["tactic"] for x in r[1:]] == ["none", "none"]


def test_rate_limit_counts_to_the_microsecond(spark, tmp_path):
    import duckdb

    from docketlens.plans.registry import ORACLE, QUERIES

    days = 30 * 86400
    at = [0.0, 0.3, 0.6, 1.2, 1.6, 1.600001, days + 0.5, days + 0.6, days + 1.7, days + 1.9]
    path = str(tmp_path / "events.parquet")
    duckdb.sql("SELECT i AS event_id, TIMESTAMP '2024-01-01' + to_microseconds(CAST(round(s * 1e6) AS BIGINT)) AS ts, 1 AS user_id, 'view' AS event_type FROM (SELECT unnest(?) AS i, unnest(?) AS s)", params=[list(range(len(at))), at]).write_parquet(path)
    got = {r["event_id"]: r["rejected"] for r in QUERIES["fil_14_rate_limit"](spark, str(tmp_path)).collect()}
    sql = ORACLE["fil_14_rate_limit"].rsplit("\n", 1)[1].replace("FROM events", f"FROM '{path}'")
    assert got == dict(duckdb.sql(sql).fetchall())
    assert not got[3] and got[5] and got[6]
