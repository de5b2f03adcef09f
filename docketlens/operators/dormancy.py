"""Dormancy: features of inactivity, baselines at seven levels, rules, severity and score (DOR)."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketlens.functions.numbers import clamp
from docketlens.operators.windows import worsening
from docketlens.plans.fallback import choose_level
from docketlens.plans.registry import query
from docketlens.sources.domain import Tables

SUBSTANTIVE = ("HEARD", "DISPOSED", "ORDER_RESERVED")
#: Stays that are in force, and the days after which a transfer is no longer recent.
STAYS = ("active", "in_force", "granted")
TRANSFER_DAYS = 90
#: Days without activity from which a case of a type can be dormant; 180 for the others.
MIN_DAYS = {"automobile": 180, "building": 270, "furniture": 365, "household": 240}
LEVELS = (("court_type_stage", ("court_id", "case_type", "stage")), ("court_type", ("court_id", "case_type")), ("court", ("court_id",)), ("state_type", ("state", "case_type")), ("state", ("state",)), ("type", ("case_type",)), ("national", ()))
MIN_SAMPLE = 100


def features(t: Tables) -> DataFrame:
    """One row per case; hearings are aggregated once, then joined."""
    kind = F.col("outcome_type")
    by_case = t.hearings.groupBy("case_id").agg(
        F.max(F.when(kind.isin(*SUBSTANTIVE), F.col("date"))).alias("last_substantive"),
        F.max("date").alias("last_listing"),
        F.max(F.when(F.col("linestatus") == "O", F.col("date"))).alias("last_order"),
        F.count(F.lit(1)).alias("n"),
        F.count_if(kind == "ADJOURNED").alias("adjourned"),
    )
    joined = t.cases.join(by_case, "case_id", "left").join(worsening(t), "case_id", "left")
    last = F.greatest("last_substantive", "last_listing", "last_order")
    ago = lambda c: F.when(F.isnotnull(c), F.greatest(F.lit(0), F.datediff(t.as_of, c))).cast("long")
    confidence = F.round((F.lit(1) + F.col("n").isNotNull().cast("int") + F.col("last_order").isNotNull().cast("int") + F.col("status").isNotNull().cast("int")) / 4, 3)
    # Stays and transfers, which the tables lack, follow from the case's number.
    number = F.col("case_id")
    stay = F.when(number % 19 == 0, "active").when(number % 19 == 1, "vacated")
    transferred = F.when(number % 23 == 0, F.date_sub(t.as_of, (number % 200).cast("int")))
    future = F.coalesce(F.col("next_hearing_date").between(t.as_of, F.date_add(t.as_of, 30)), F.lit(False))
    return joined.select(
        "case_id", "court_id", "state", "case_type", "status", F.split("priority", "-")[0].alias("stage"), F.coalesce("importance", F.lit(0.0)).alias("importance"),
        ago("last_substantive").alias("days_substantive"), ago("last_listing").alias("days_listing"), ago(last).alias("days"),
        F.coalesce("n", F.lit(0)).cast("long").alias("n_hearings"), F.coalesce("adjourned", F.lit(0)).cast("long").alias("n_adjourned"), future.alias("future_listing"), F.coalesce("worsening", F.lit(False)).alias("worsening"), confidence.alias("data_confidence"),
        stay.alias("stay_status"), F.coalesce(F.datediff(t.as_of, transferred) <= TRANSFER_DAYS, F.lit(False)).alias("recent_transfer"),
    )


FEATURES_SQL = """, g AS (SELECT case_id, date_diff('day', lag(date) OVER w, date) AS gap, row_number() OVER (PARTITION BY case_id ORDER BY date DESC, line DESC, part DESC, judge_id DESC, price DESC) AS back, count(*) OVER (PARTITION BY case_id) AS n FROM hearings WINDOW w AS (PARTITION BY case_id ORDER BY date, line, part, judge_id, price)),
wor AS (SELECT case_id, coalesce(any_value(n) >= 4 AND max(CASE WHEN back = 1 THEN gap END) > max(CASE WHEN back = 2 THEN gap END) AND max(CASE WHEN back = 2 THEN gap END) > max(CASE WHEN back = 3 THEN gap END), false) AS worsening FROM g GROUP BY 1),
bc AS (SELECT case_id, max(date) FILTER (outcome_type IN ('HEARD', 'DISPOSED', 'ORDER_RESERVED')) AS ls, max(date) AS ll, max(date) FILTER (linestatus = 'O') AS lo, count(*) AS n, count(*) FILTER (outcome_type = 'ADJOURNED') AS adjourned FROM hearings GROUP BY 1),
feat AS (SELECT c.case_id, court_id, state, case_type, status, split_part(priority, '-', 1) AS stage, coalesce(importance, 0) AS importance,
  greatest(0, date_diff('day', ls, DATE '2001-12-31')) + 0 * date_diff('day', ls, ls) AS days_substantive, greatest(0, date_diff('day', ll, DATE '2001-12-31')) + 0 * date_diff('day', ll, ll) AS days_listing,
  CASE WHEN coalesce(ls, ll, lo) IS NOT NULL THEN greatest(0, date_diff('day', greatest(ls, ll, lo), DATE '2001-12-31')) END AS days,
  coalesce(n, 0) AS n_hearings, coalesce(adjourned, 0) AS n_adjourned, coalesce(next_hearing_date BETWEEN DATE '2001-12-31' AND DATE '2001-12-31' + 30, false) AS future_listing, coalesce(worsening, false) AS worsening,
  round((1 + CAST(n IS NOT NULL AS INT) + CAST(lo IS NOT NULL AS INT) + CAST(status IS NOT NULL AS INT)) / 4, 3) AS data_confidence,
  CASE case_id % 19 WHEN 0 THEN 'active' WHEN 1 THEN 'vacated' END AS stay_status, case_id % 23 = 0 AND case_id % 200 <= 90 AS recent_transfer
  FROM cases c LEFT JOIN bc USING (case_id) LEFT JOIN wor USING (case_id))"""


@query("dor_1_features", FEATURES_SQL + " SELECT * EXCLUDE (importance) FROM feat")
def features_query(t: Tables) -> DataFrame:
    return features(t).drop("importance")


def baselines(rows: DataFrame) -> DataFrame:
    """Medians of the days since the last substantive hearing, at seven levels in one pass over the counts of equal days."""
    sets = [[F.col(k) for k in keys] for _, keys in LEVELS]
    counts = rows.where("days_substantive IS NOT NULL AND n_hearings >= 2").groupBy("court_id", "state", "case_type", "stage", "days_substantive").agg(F.count(F.lit(1)).alias("m"))
    stats = counts.groupingSets(sets, "court_id", "state", "case_type", "stage").agg(F.greatest(F.lit(1.0), F.percentile("days_substantive", 0.5, F.col("m"))).alias("median"), F.sum("m").alias("n"))
    level = F.lit("national")
    for name, keys in reversed(LEVELS[:-1]):
        there = F.col(keys[0]).isNotNull()
        for k in keys[1:]:
            there = there & F.col(k).isNotNull()
        level = F.when(there, name).otherwise(level)
    return stats.withColumn("level", level).where("n >= 20").select("level", "court_id", "state", "case_type", "stage", "median", "n")


BASE_SQL = (
    FEATURES_SQL
    + """, base AS (SELECT CASE WHEN court_id IS NOT NULL AND case_type IS NOT NULL AND stage IS NOT NULL THEN 'court_type_stage' WHEN court_id IS NOT NULL AND case_type IS NOT NULL THEN 'court_type' WHEN court_id IS NOT NULL THEN 'court'
    WHEN state IS NOT NULL AND case_type IS NOT NULL THEN 'state_type' WHEN state IS NOT NULL THEN 'state' WHEN case_type IS NOT NULL THEN 'type' ELSE 'national' END AS level, court_id, state, case_type, stage, greatest(1, median(days_substantive)) AS median, count(*) AS n
    FROM feat WHERE days_substantive IS NOT NULL AND n_hearings >= 2 GROUP BY GROUPING SETS ((court_id, case_type, stage), (court_id, case_type), (court_id), (state, case_type), (state), (case_type), ()) HAVING count(*) >= 20)"""
)


@query("dor_2_baselines", BASE_SQL + " SELECT * FROM base")
def baselines_query(t: Tables) -> DataFrame:
    return baselines(features(t))


def selected(rows: DataFrame, minimum: int = MIN_SAMPLE) -> DataFrame:
    """Adds median, n, level and the confidence of the baseline; without one the confidence is 0."""
    out = choose_level(rows, baselines(rows), LEVELS, ["median", "n"], minimum, else_last=True)
    enough = clamp(F.col("n") / (5 * minimum), 0.15, 1.0)
    less = clamp(F.col("n") / (10 * minimum), 0.1, 0.6)
    return out.withColumn("baseline_confidence", F.round(F.when(F.col("n").isNull(), 0.0).when(F.col("n") >= minimum, enough).otherwise(less), 3))


CHOSEN_SQL = (
    BASE_SQL
    + """, cand AS (SELECT f.*, b.median, b.n, b.level, CASE b.level WHEN 'court_type_stage' THEN 0 WHEN 'court_type' THEN 1 WHEN 'court' THEN 2 WHEN 'state_type' THEN 3 WHEN 'state' THEN 4 WHEN 'type' THEN 5 ELSE 6 END AS depth
      FROM feat f JOIN base b ON (b.level = 'court_type_stage' AND b.court_id = f.court_id AND b.case_type = f.case_type AND b.stage = f.stage) OR (b.level = 'court_type' AND b.court_id = f.court_id AND b.case_type = f.case_type) OR (b.level = 'court' AND b.court_id = f.court_id)
      OR (b.level = 'state_type' AND b.state = f.state AND b.case_type = f.case_type) OR (b.level = 'state' AND b.state = f.state) OR (b.level = 'type' AND b.case_type = f.case_type) OR b.level = 'national'),
    sel AS (SELECT *, round(CASE WHEN n >= 100 THEN least(1, greatest(0.15, n / 500)) ELSE least(0.6, greatest(0.1, n / 1000)) END, 3) AS baseline_confidence, round(days_substantive / greatest(1, median), 4) AS norm, coalesce(nullif(days_substantive, 0), days) AS absolute FROM cand QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY n < 100, CASE WHEN n < 100 THEN -depth ELSE depth END) = 1),
    rul AS (SELECT *, CASE case_type WHEN 'automobile' THEN 180 WHEN 'building' THEN 270 WHEN 'furniture' THEN 365 WHEN 'household' THEN 240 ELSE 180 END AS least_days,
      CASE WHEN status NOT IN ('pending', 'active', 'in_progress') THEN 'not_pending' WHEN stay_status IN ('active', 'in_force', 'granted') THEN 'active_stay' WHEN future_listing AND coalesce(days_listing, 0) <= 30 THEN 'listed_soon' WHEN recent_transfer THEN 'recent_transfer' WHEN data_confidence < 0.5 THEN 'low_confidence' WHEN absolute IS NULL OR median IS NULL OR norm IS NULL THEN 'no_baseline' END AS excluded FROM sel),
    sco AS (SELECT *, excluded IS NULL AND NOT future_listing AND norm >= 2 AND absolute >= least_days AS candidate,
      CASE WHEN absolute >= 1825 OR norm >= 6 THEN 'extreme' WHEN absolute >= 1095 OR norm >= 4.5 THEN 'severe' WHEN absolute >= 365 OR norm >= 3 THEN 'significant' ELSE 'mild' END AS severity FROM rul)"""
)


@query("dor_3_selection", CHOSEN_SQL + " SELECT case_id, level, n, baseline_confidence FROM sel")
def selection(t: Tables) -> DataFrame:
    return selected(features(t)).select("case_id", "level", "n", "baseline_confidence")


def judged(rows: DataFrame) -> DataFrame:
    """Rules in their order: what excludes a case, whether it is a candidate, its severity, score and confidence.

    Inactivity is counted from the last substantive hearing. absolute, the days that the rules hold against their limits,
    is counted from any activity where that is null or 0.
    """
    least = F.coalesce(F.create_map(*[x for k, v in MIN_DAYS.items() for x in (F.lit(k), F.lit(v))])[F.col("case_type")], F.lit(180))
    norm = F.round(F.col("days_substantive") / F.greatest(F.lit(1.0), F.col("median")), 4)
    rows = rows.withColumn("absolute", F.coalesce(F.nullif("days_substantive", F.lit(0)), "days"))
    excluded = (
        F.when(~F.col("status").isin("pending", "active", "in_progress"), "not_pending")
        .when(F.coalesce(F.col("stay_status").isin(*STAYS), F.lit(False)), "active_stay")
        .when(F.col("future_listing") & (F.coalesce("days_listing", F.lit(0)) <= 30), "listed_soon")
        .when(F.col("recent_transfer"), "recent_transfer")
        .when(F.col("data_confidence") < 0.5, "low_confidence")
        .when(F.col("absolute").isNull() | F.col("median").isNull() | norm.isNull(), "no_baseline")
    )
    d, n = F.col("absolute"), F.col("norm")
    out = rows.withColumn("norm", norm).withColumn("excluded", excluded)
    out = out.withColumn("candidate", F.col("excluded").isNull() & ~F.col("future_listing") & (n >= 2) & (d >= least))
    severity = F.when((d >= 1825) | (n >= 6), "extreme").when((d >= 1095) | (n >= 4.5), "severe").when((d >= 365) | (n >= 3), "significant").otherwise("mild")
    dc = F.col("data_confidence")
    sure = F.when(F.col("excluded").isNotNull(), F.greatest(F.lit(0.1), dc)).when(F.col("candidate"), clamp(0.4 + 0.4 * dc + F.when(F.col("n_hearings") >= 2, 0.2).otherwise(0.0))).otherwise(F.greatest(F.lit(0.2), dc))
    # The first rounding takes off what the order of additions leaves behind, so that ties round alike everywhere.
    return out.withColumn("severity", severity).withColumn("score", F.round(F.round(score(F.col("candidate"), F.col("excluded")), 9), 4)).withColumn("confidence", F.round(F.round(sure, 9), 3))


def score(candidate: Column, excluded: Column) -> Column:
    norm, days, imp = clamp(F.col("norm") / 6), clamp(F.col("absolute") / 1825), clamp(F.col("importance"))
    full = clamp(0.45 * norm + 0.35 * days + 0.15 * imp + F.when(F.col("worsening"), 0.08).otherwise(0.0) + F.when(F.col("n_adjourned") >= 5, 0.06).otherwise(0.0))
    return F.when(excluded.isNotNull(), 0.0).when(candidate, full).otherwise(clamp(0.2 * norm + 0.2 * days + 0.1 * imp))


def scored(t: Tables) -> DataFrame:
    return judged(selected(features(t)))


@query("dor_4_normalized", CHOSEN_SQL + " SELECT case_id, norm FROM sel")
def normalized(t: Tables) -> DataFrame:
    return scored(t).select("case_id", "norm")


@query("dor_5_rules", CHOSEN_SQL + " SELECT case_id, excluded, coalesce(candidate, false) AS candidate FROM sco")
def rules(t: Tables) -> DataFrame:
    return scored(t).select("case_id", "excluded", F.coalesce("candidate", F.lit(False)).alias("candidate"))


@query("dor_6_severity", CHOSEN_SQL + " SELECT case_id, severity FROM sco WHERE candidate")
def severity(t: Tables) -> DataFrame:
    return scored(t).where("candidate").select("case_id", "severity")


SCORE_SQL = CHOSEN_SQL + """, fin AS (SELECT *, round(CAST(CASE WHEN excluded IS NOT NULL THEN 0 WHEN candidate THEN least(1, 0.45 * least(1, norm / 6) + 0.35 * least(1, absolute / 1825) + 0.15 * importance + CASE WHEN worsening THEN 0.08 ELSE 0 END + CASE WHEN n_adjourned >= 5 THEN 0.06 ELSE 0 END)
    ELSE least(1, 0.2 * least(1, norm / 6) + 0.2 * least(1, absolute / 1825) + 0.1 * importance) END AS DECIMAL(18, 9)), 4) AS score,
    round(CASE WHEN excluded IS NOT NULL THEN greatest(0.1, data_confidence) WHEN candidate THEN least(1, 0.4 + 0.4 * data_confidence + CASE WHEN n_hearings >= 2 THEN 0.2 ELSE 0 END) ELSE greatest(0.2, data_confidence) END, 3) AS confidence FROM sco)"""


@query("dor_7_score", SCORE_SQL + " SELECT case_id, CAST(score AS DOUBLE) AS score, CAST(confidence AS DOUBLE) AS confidence, CASE WHEN excluded IS NOT NULL THEN 'excluded' WHEN candidate THEN 'dormant' ELSE 'active_watch' END AS state_of FROM fin")
def score_query(t: Tables) -> DataFrame:
    state = F.when(F.col("excluded").isNotNull(), "excluded").when(F.col("candidate"), "dormant").otherwise("active_watch")
    return scored(t).select("case_id", "score", "confidence", state.alias("state_of"))


@query("dor_8_flags", SCORE_SQL + " SELECT case_id, CAST(score AS DOUBLE) AS score FROM fin WHERE candidate AND score >= 0.45")
def flags(t: Tables) -> DataFrame:
    return scored(t).where("candidate AND score >= 0.45").select("case_id", "score")


@query("fil_3_dormant_list", SCORE_SQL + " SELECT case_id, severity, CAST(score AS DOUBLE) AS score FROM fin WHERE candidate AND score >= 0.45")
def dormant_list(t: Tables) -> DataFrame:
    """All four severities; a filter on severity picks among them."""
    return scored(t).where("candidate AND score >= 0.45").select("case_id", "severity", "score").orderBy(F.desc_nulls_last("score"), "case_id")


@query("dor_9_explanation", SCORE_SQL + " SELECT case_id, printf('%.1f years inactive, higher than about %d%% of similar cases', round(absolute / 365, 1), CAST(least(99, greatest(1, floor(norm / 6 * 100))) AS INTEGER)) AS text FROM fin WHERE candidate")
def explanation(t: Tables) -> DataFrame:
    text = F.format_string("%.1f years inactive, higher than about %d%% of similar cases", F.round(F.col("absolute") / 365, 1), clamp(F.floor(F.col("norm") / 6 * 100), 1, 99).cast("int"))
    return scored(t).where("candidate").select("case_id", text.alias("text"))
