"""Steps that large tables showed to be made several times over: each is made once, with the same rows."""

import datetime as dt

import pytest

from docketlens.operators import articles, delay, dormancy, survival, tactics
from docketlens.sources.domain import Tables


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture(scope="module")
def tables(spark, small):
    return Tables(spark, small)


def test_attribution_scores_each_sign_once(tables):
    plan = optimized(tactics.attribution(tables))
    # \S+ as well as the product that is clamped stood in the plan once for each comparison and each branch.
    assert plan.count("regexp_extract_all") == 1
    assert plan.count("1.08") == 1


def test_attribution_of_unknown_advocates(spark, tables):
    """Without an advocate, a direct sign does not stand against the pattern; with one it does."""
    t = Tables(spark, tables.sf_dir)
    columns = "case_id long, date date, line int, part long, judge_id long, outcome_type string, confidence double, discount double, tax double, linestatus string"
    row = lambda case, judge, line: (case, dt.date(2001, 1, 1), line, 1, judge, "NOT_REACHED", 0.9, 0.09, 0.04, "O")
    t.hearings = spark.createDataFrame([row(1, None, 1), row(1, None, 2), row(2, 7, 1), row(2, 7, 2), row(3, 7, 1)], columns)
    rows = {(r["case_id"], r["advocate_id"], r["kind"]): (r["n"], r["confidence"], r["share"], r["days"]) for r in tactics.attribution(t, 0.5).collect()}
    # 0.40 for an injunction, 0.10 for its dismissal, 0.12, 0.10 for the flag and 0.08 for 45 days
    assert {k[2] for k in rows} == {"application", "pattern"}
    assert rows[(1, None, "pattern")] == (1, 0.5, 25.0, 14)
    assert rows[(2, 7, "application")] == (2, rows[(3, 7, "application")][1], rows[(3, 7, "application")][2], 90)
    assert (2, 7, "pattern") not in rows and (3, 7, "pattern") not in rows


@pytest.mark.parametrize("build", [tactics.batch_stats, tactics.batches])
def test_batch_statistics_make_features_once(tables, build):
    # What is left after the counts reads no table but the few rows that are kept.
    assert "l_orderkey" not in optimized(build(tables))


def test_batch_statistics_of_few(spark):
    rows = spark.createDataFrame([(1, 10.0), (1, 59.9999999), (1, 60.0), (1, 60.0), (1, None), (2, 7.5)], "batch int, p double")
    got = {r["batch"]: r.asDict() for r in tactics.batch_statistics(rows, ["batch"]).collect()}
    assert got[1] == {"batch": 1, "n": 5, "mean": 47.5, "low": 10.0, "high": 60.0, "sd": 25.0, "suspects": 2, "upper_median": 60.0}
    assert (got[2]["n"], got[2]["mean"], got[2]["sd"], got[2]["upper_median"]) == (1, 7.5, None, 7.5)
    none = tactics.batch_statistics(rows.where("batch = 3"), []).collect()
    assert len(none) == 1 and (none[0]["n"], none[0]["mean"], none[0]["upper_median"]) == (0, None, None)


def test_predictions_need_no_latest_judge(tables):
    assert "max_by" not in optimized(survival.flags(tables))


@pytest.mark.parametrize("build", [lambda t: delay.baselines(delay.case_delays(t.case_spans, t.as_of, 7)), lambda t: dormancy.baselines(dormancy.features(t))])
def test_levels_expand_counts(tables, build):
    plan = optimized(build(tables))
    # Below the rows that are made for each level, equal values are counted already.
    assert plan.count("Expand") == 1 and "count(1)" in plan.split("Expand")[1].split("Join")[0]


def test_percentiles_weigh_equal_values(spark):
    rows = spark.createDataFrame([(1, "a", "x", v) for v in (10, 10, 10, 40, 50)], "court_id int, state string, case_type string, delay long")
    got = {r["level"]: (r["median"], r["p75"], r["p90"], r["n"]) for r in delay.baselines(rows).collect()}
    assert got == dict.fromkeys((name for name, _ in delay.LEVELS), (10.0, 40.0, 46.0, 5))


def test_party_matches_are_not_shuffled(tables):
    """An article holds a pair of names once, so that no pair of article and case is dealt by its keys."""
    plan = optimized(articles.by_parties(articles.articles(tables), articles.known_cases(tables)))
    assert not plan.split("Join")[0].count("Aggregate")
