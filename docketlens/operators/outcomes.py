"""Hearing outcomes from text: ordered keyword rules, corroboration and review (OUT)."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketlens.plans.registry import query
from docketlens.sources.domain import TEXT_SQL, Tables, with_text

#: Rules in their order, with outcome, confidence and whole-word keywords.
RULES = (
    ("ADJOURNED", 0.95, ("adjourn", "postponed", "deferred", "put up", "relisted", "adjd", "adjd.", "adj.", "adjourned to")),
    ("HEARD", 0.92, ("heard", "argument heard", "taken up", "considered", "heard today")),
    ("ORDER_RESERVED", 0.93, ("order reserved", "order kept", "reserved", "orders reserved")),
    ("DISPOSED", 0.96, ("disposed", "dismissed", "allowed", "pronounced", "judgment")),
    ("NOT_REACHED", 0.90, ("not reached", "not taken up", "not heard", "case not taken")),
    ("NO_PROCEEDINGS", 0.90, ("no proceedings",)),
)
#: The substring cascade of the backfill; its confidences have an order of their own.
CASCADE = (
    ("ADJOURNED", ("adjourn", "postponed", "deferred", "put up", "relisted", "adjd", "adj.")),
    ("ORDER_RESERVED", ("order reserved", "orders reserved", "order kept")),
    ("DISPOSED", ("disposed", "dismissed", "pronounced", "judgment", "allowed")),
    ("HEARD", ("heard", "considered", "taken up")),
    ("NO_PROCEEDINGS", ("no proceedings",)),
    ("NOT_REACHED", ("not reached", "not taken up", "not heard", "case not taken")),
)
CASCADE_CONFIDENCE = (("ADJOURNED", 0.95), ("DISPOSED", 0.96), ("ORDER_RESERVED", 0.93), ("HEARD", 0.92), ("NO_PROCEEDINGS", 0.90), ("NOT_REACHED", 0.90))


def normalise(text: Column) -> Column:
    """Lower case, all but ASCII letters, digits and dots to spaces, spaces folded."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z0-9.\s]", " "), r"\s+", " "))


def words_pattern(keywords) -> str:
    return r"\b(?:" + "|".join(k.replace(".", r"\.").replace(" ", r"\s+") for k in keywords) + r")\b"


def parsed(text: Column, listing: Column | None = None) -> Column:
    """struct(outcome, confidence): the first rule that matches; an empty text is a listing."""
    t = normalise(text)
    result = lambda o, c: F.struct(F.lit(o).alias("outcome"), F.lit(c).alias("confidence"))
    out = None
    for outcome, confidence, keywords in RULES:
        hit = t.rlike(words_pattern(keywords))
        if outcome == "HEARD":  # "not heard" and "not taken up" are no hearing
            spoken = [k for k in keywords if k.endswith("heard") or k == "heard today"]
            hit = (t.rlike(words_pattern(spoken)) & ~t.rlike(r"\bnot\s+heard\b")) | (t.rlike(words_pattern(["taken up"])) & ~t.rlike(r"\bnot\s+taken\s+up\b")) | t.rlike(words_pattern(["considered"]))
        out = F.when(hit, result(outcome, confidence)) if out is None else out.when(hit, result(outcome, confidence))
    foreign = F.coalesce(text, F.lit("")).rlike(r"[^\x00-\x7F]") & (F.regexp_replace(t, r"[^a-z]", "") == "")
    return out.when(foreign, result("OTHER", 0.30)).when((t == "") if listing is None else (t == "") | listing, result("LISTED", 0.85)).otherwise(result("OTHER", 0.35))


def _like(column: str, words) -> str:
    return "(" + " OR ".join(f"{column} LIKE '%{w}%'" for w in words) + ")"


def _match(words) -> str:
    return "regexp_matches(t, '" + words_pattern(words) + "')"


_heard = "((" + _match(["heard", "argument heard", "heard today"]) + r" AND NOT regexp_matches(t, '\bnot\s+heard\b')) OR (" + _match(["taken up"]) + r" AND NOT regexp_matches(t, '\bnot\s+taken\s+up\b')) OR " + _match(["considered"]) + ")"
PARSED_SQL = (
    TEXT_SQL
    + r", n AS (SELECT *, trim(regexp_replace(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9.\s]', ' ', 'g'), '\s+', ' ', 'g')) AS t FROM texts), p AS (SELECT *, CASE "
    + " ".join(f"WHEN {_heard if o == 'HEARD' else _match(k)} THEN '{o}'" for o, _, k in RULES)
    + " WHEN t = '' THEN 'LISTED' ELSE 'OTHER' END AS outcome FROM n), q AS (SELECT *, CASE outcome "
    + " ".join(f"WHEN '{o}' THEN {c}" for o, c, _ in RULES)
    + " WHEN 'LISTED' THEN 0.85 ELSE 0.35 END AS conf FROM p)"
)


@query("out_1_rules", PARSED_SQL + " SELECT case_id, date, line, part, outcome, CAST(conf AS DOUBLE) AS conf FROM q")
def rules(t: Tables) -> DataFrame:
    return with_text(t.hearings).withColumn("r", parsed(F.col("text"))).select("case_id", "date", "line", "part", F.col("r.outcome").alias("outcome"), F.col("r.confidence").alias("conf"))


def noisy_or(confidences: Column) -> Column:
    """1 - prod(1 - c) over an array."""
    return 1 - F.aggregate(confidences, F.lit(1.0), lambda a, c: a * (1 - c))


@query(
    "out_2_corroboration",
    PARSED_SQL + """, g AS (SELECT case_id, date, outcome, count(*) AS signals, 1 - product(1 - conf) AS combined FROM q GROUP BY ALL)
    SELECT case_id, date, outcome, signals, round(CASE WHEN outcome = 'DISPOSED' THEN greatest(0.99, combined) ELSE combined END, 8) AS combined FROM g""",
)
def corroboration(t: Tables) -> DataFrame:
    """Signals of one case and day that agree strengthen each other; a disposal is all but certain."""
    s = with_text(t.hearings).withColumn("r", parsed(F.col("text"))).groupBy("case_id", "date", F.col("r.outcome").alias("outcome")).agg(F.count(F.lit(1)).alias("signals"), F.array_sort(F.collect_list("r.confidence")).alias("c"))
    combined = noisy_or(F.col("c"))
    return s.select("case_id", "date", "outcome", "signals", F.round(F.when(F.col("outcome") == "DISPOSED", F.greatest(F.lit(0.99), combined)).otherwise(combined), 8).alias("combined"))


@query("out_4_needs_review", PARSED_SQL + " SELECT outcome, count(*) AS n, count(*) FILTER (outcome = 'OTHER' OR conf < 0.60) AS review FROM q GROUP BY 1")
def needs_review(t: Tables) -> DataFrame:
    r = with_text(t.hearings).select(parsed(F.col("text")).alias("r"))
    return r.groupBy(F.col("r.outcome").alias("outcome")).agg(F.count(F.lit(1)).alias("n"), F.count_if((F.col("r.outcome") == "OTHER") | (F.col("r.confidence") < 0.60)).alias("review"))


@query("out_8_cascade", TEXT_SQL + ", l AS (SELECT *, lower(text) AS x FROM texts) SELECT case_id, date, line, part, CASE WHEN text IS NULL OR trim(text) = '' THEN 'LISTED' " + " ".join(f"WHEN {_like('x', w)} THEN '{o}'" for o, w in CASCADE) + " ELSE 'OTHER' END AS outcome, CAST(CASE WHEN text IS NULL OR trim(text) = '' THEN 0.85 " + " ".join(f"WHEN {_like('x', dict(CASCADE)[o])} THEN {c}" for o, c in CASCADE_CONFIDENCE) + " ELSE 0.40 END AS DOUBLE) AS conf FROM l")
def cascade(t: Tables) -> DataFrame:
    x = F.lower("text")
    has = {o: F.lit(False) for o, _ in CASCADE}
    for o, words in CASCADE:
        for w in words:
            has[o] = has[o] | x.contains(w)
    blank = F.col("text").isNull() | (F.trim("text") == "")
    outcome, confidence = F.when(blank, "LISTED"), F.when(blank, 0.85)
    for o, _ in CASCADE:
        outcome = outcome.when(has[o], o)
    for o, c in CASCADE_CONFIDENCE:
        confidence = confidence.when(has[o], c)
    return with_text(t.hearings).select("case_id", "date", "line", "part", outcome.otherwise("OTHER").alias("outcome"), confidence.otherwise(0.40).alias("conf"))
