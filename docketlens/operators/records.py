"""Records on their way in and out: validation, cause lists, signals, listings and export projections (ING, SRC, OUT, FIL, PRJ)."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketlens.operators.delay import CHOSEN_SQL, scored
from docketlens.operators.outcomes import PARSED_SQL, RULES, normalise, parsed, words_pattern
from docketlens.plans.registry import query
from docketlens.sources.domain import TEXT_SQL, Tables, with_text

#: Elements and classes of a cause list's rows, how many are read and how long they must be.
ROW = r"""<(?:tr|div|li)[^>]*class=["'](?:case|cause|listing|row|case-row|entry)["'][^>]*>([^<]*)<"""
MOST_ROWS, LEAST_CHARS = 40, 10
#: Tokens of an order that disposes of a case.
DISPOSAL = ("disposed", "dismissed", "allowed", "pronounced", "judgment")
#: What a hearing date may look like in a record, in the order of numbers; the tables lack such text.
DATES = ("yyyy-MM-dd", "dd/MM/yyyy", "'on 'yyyy-MM-dd' at noon'", "'n/a'", "''")


def dates_of(text: Column) -> Column:
    """ISO dates, then day/month/year, then the first ISO date inside the text; null where there is none."""
    found = F.regexp_extract(text, r"(\d{4}-\d{2}-\d{2})", 1)
    return F.coalesce(F.try_to_date(text, "yyyy-MM-dd"), F.try_to_date(text, "dd/MM/yyyy"), F.try_to_date(F.nullif(found, F.lit("")), "yyyy-MM-dd"))


def raw_records(t: Tables) -> DataFrame:
    text = F.lit("")
    for i, pattern in enumerate(DATES[:4]):
        text = F.when(F.col("o_orderkey") % 5 == i, F.date_format("o_orderdate", pattern)).otherwise(text)
    bench = F.when(F.col("o_orderkey") % 11 != 0, F.col("o_orderpriority")).otherwise("  ")
    return t.read("orders").select(F.col("o_orderkey").alias("case_id"), F.col("o_orderkey").cast("string").alias("case_number"), F.year("o_orderdate").alias("filing_year"), text.alias("hearing_date"), bench.alias("raw_bench"), F.col("o_orderstatus").alias("raw_outcome"))


def validated(records: DataFrame) -> DataFrame:
    """records with their date and the fields that are missing or wrong, comma-joined; those with any go to quarantine."""
    blank = lambda c: F.coalesce(F.trim(c.cast("string")), F.lit("")) == ""
    date = dates_of(F.col("hearing_date"))
    wrong = [F.when(blank(F.col(c)), F.lit(c)) for c in ("case_number", "filing_year", "raw_bench", "raw_outcome")]
    fields = F.array_join(F.array_compact(F.array(*wrong[:2], F.when(date.isNull(), F.lit("hearing_date")), *wrong[2:])), ",")
    return records.withColumn("date", date).withColumn("wrong", fields)


@query(
    "ing_2_firewall",
    r"""SELECT case_id, date, wrong, wrong <> '' AS quarantined FROM (SELECT case_id, date, array_to_string(list_filter([CASE WHEN date IS NULL THEN 'hearing_date' END, CASE WHEN trim(bench) = '' THEN 'raw_bench' END], lambda x: x IS NOT NULL), ',') AS wrong
    FROM (SELECT o_orderkey AS case_id, CASE WHEN o_orderkey % 5 < 3 THEN CAST(o_orderdate AS DATE) END AS date, CASE WHEN o_orderkey % 11 <> 0 THEN o_orderpriority ELSE '  ' END AS bench FROM orders))""",
)
def firewall(t: Tables) -> DataFrame:
    return validated(raw_records(t)).select("case_id", "date", "wrong", (F.col("wrong") != "").alias("quarantined"))


@query("src_3_cause_list", "SELECT page_id, CAST(i - 1 AS INTEGER) AS row, x AS text FROM (SELECT page_id, unnest(l) AS x, generate_subscripts(l, 1) AS i FROM (SELECT page_id, list_filter(list_transform((regexp_extract_all(html, '" + ROW.replace("'", "''") + "', 1))[1:40], lambda x: trim(x)), lambda x: length(x) > 10) AS l FROM pages) WHERE len(l) > 0) UNION ALL SELECT page_id, 0, 'no listing found' FROM pages WHERE len(list_filter(list_transform((regexp_extract_all(html, '" + ROW.replace("'", "''") + "', 1))[1:40], lambda x: trim(x)), lambda x: length(x) > 10)) = 0")
def cause_list(t: Tables) -> DataFrame:
    """The rows of a page's cause list, or one row that says there is none."""
    return cause_rows(t.read("pages").select("page_id", "html"))


def cause_rows(pages: DataFrame) -> DataFrame:
    texts = F.filter(F.transform(F.slice(F.regexp_extract_all("html", F.lit(ROW), F.lit(1)), 1, MOST_ROWS), lambda x: F.trim(x)), lambda x: F.length(x) > LEAST_CHARS)
    rows = pages.select("page_id", F.posexplode_outer(texts).alias("row", "text"))
    return rows.select("page_id", F.coalesce("row", F.lit(0)).alias("row"), F.coalesce("text", F.lit("no listing found")).alias("text"))


@query("out_3_signals", TEXT_SQL + r", o AS (SELECT case_id, date, trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9.\s]', ' ', 'g'), '\s+', ' ', 'g')) AS t FROM texts WHERE linestatus = 'O') SELECT case_id, date, CASE WHEN regexp_matches(t, '" + words_pattern(DISPOSAL) + "') THEN 'DISPOSED' ELSE 'HEARD' END AS outcome, count(*) AS n, CAST(max(CASE WHEN regexp_matches(t, '" + words_pattern(DISPOSAL) + "') THEN 0.99 ELSE 0.88 END) AS DOUBLE) AS confidence FROM o GROUP BY ALL")
def signals(t: Tables) -> DataFrame:
    """What the orders of a day say of its hearing: disposed where the text has such a word, else heard."""
    disposed = normalise(F.col("text")).rlike(words_pattern(DISPOSAL))
    s = with_text(t.hearings).where("linestatus = 'O'").select("case_id", "date", F.when(disposed, "DISPOSED").otherwise("HEARD").alias("outcome"), F.when(disposed, 0.99).otherwise(0.88).alias("c"))
    return s.groupBy("case_id", "date", "outcome").agg(F.count(F.lit(1)).alias("n"), F.max("c").alias("confidence"))


def adjournment_keyword(text: Column) -> Column:
    """The first keyword of the adjournment rule that a text has, or null; adjourned to is named adjourned."""
    t = normalise(text)
    found = F.coalesce(*[F.when(t.rlike(words_pattern([k])), F.lit(k)) for k in RULES[0][2]])
    return F.when(parsed(text)["outcome"] == "ADJOURNED", F.when(found == "adjourned to", "adjourned").otherwise(found))


@query("out_5_adjournments", PARSED_SQL + " SELECT case_id, date, line, part, outcome = 'ADJOURNED' AS adjourned, CASE WHEN outcome = 'ADJOURNED' THEN CASE " + " ".join(f"WHEN regexp_matches(t, '{words_pattern([k])}') THEN '{'adjourned' if k == 'adjourned to' else k}'" for k in RULES[0][2]) + " END END AS keyword FROM q")
def adjournments(t: Tables) -> DataFrame:
    keyword = adjournment_keyword(F.col("text"))
    return with_text(t.hearings).select("case_id", "date", "line", "part", keyword.isNotNull().alias("adjourned"), keyword.alias("keyword"))


@query("out_7_evidence", PARSED_SQL + ", e AS (SELECT case_id, date, outcome, count(*) AS n, string_agg(DISTINCT CAST(judge_id AS VARCHAR), ',' ORDER BY CAST(judge_id AS VARCHAR)) AS judges FROM q GROUP BY ALL) SELECT * FROM e")
def evidence(t: Tables) -> DataFrame:
    """For each case, day and outcome: how many records say so and the judges they name. A day's records are few."""
    s = with_text(t.hearings).select("case_id", "date", "judge_id", parsed(F.col("text"))["outcome"].alias("outcome"))
    return s.groupBy("case_id", "date", "outcome").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_set(F.col("judge_id").cast("string"))), ",").alias("judges"))


@query("fil_9_run_listing", ", r AS (SELECT event_type AS source, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY ALL) SELECT * FROM r ORDER BY day DESC, source OFFSET 10 LIMIT 50")
def run_listing(t: Tables, offset: int = 10, limit: int = 50) -> DataFrame:
    """A page of runs, newest first."""
    runs = t.read("events").groupBy(F.col("event_type").alias("source"), F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return runs.orderBy(F.desc("day"), "source").offset(offset).limit(limit)


@query("fil_10_feedback", "SELECT conv_id, turn, role FROM conversations WHERE role IN ('user', 'system') AND text ILIKE '%a%' ORDER BY conv_id DESC, turn DESC, role")
def feedback(t: Tables) -> DataFrame:
    """Entries in some states that hold a word, newest first."""
    rows = t.read("conversations").where(F.col("role").isin("user", "system") & F.col("text").ilike("%a%"))
    return rows.select("conv_id", "turn", "role").orderBy(F.desc("conv_id"), F.desc("turn"), "role")


@query("fil_12_tracking", "SELECT case_id, CASE WHEN status = 'pending' AND date_diff('day', filing_date, DATE '2001-12-31') > 90 THEN 'expired' WHEN status = 'in_progress' AND date_diff('day', filing_date, DATE '2001-12-31') > 5 THEN 'unacknowledged' END AS due FROM cases WHERE (status = 'pending' AND date_diff('day', filing_date, DATE '2001-12-31') > 90) OR (status = 'in_progress' AND date_diff('day', filing_date, DATE '2001-12-31') > 5)")
def tracking(t: Tables) -> DataFrame:
    """Drafts older than 90 days and requests without an answer for more than five."""
    age = F.datediff(t.as_of, "filing_date")
    due = F.when((F.col("status") == "pending") & (age > 90), "expired").when((F.col("status") == "in_progress") & (age > 5), "unacknowledged")
    return t.cases.select("case_id", due.alias("due")).where("due IS NOT NULL")


@query("srt_8_last_failures", "SELECT event_id, event_type FROM events WHERE value < 5 ORDER BY ts DESC, event_id DESC LIMIT 100")
def last_failures(t: Tables, limit: int = 100) -> DataFrame:
    return t.read("events").where("value < 5").orderBy(F.desc("ts"), F.desc("event_id")).select("event_id", "event_type").limit(limit)


@query("ing_16_backfill", "SELECT case_id, date, line, part FROM hearings WHERE outcome_type = 'LISTED' ORDER BY date DESC, case_id, line, part LIMIT 500")
def backfill(t: Tables, limit: int = 500) -> DataFrame:
    """The hearings that a backfill takes next."""
    return t.hearings.where("outcome_type = 'LISTED'").orderBy(F.desc("date"), "case_id", "line", "part").select("case_id", "date", "line", "part").limit(limit)


@query("ing_14_hearing_upsert", PARSED_SQL + ", l AS (SELECT * FROM q QUALIFY row_number() OVER (PARTITION BY case_id, date ORDER BY line DESC, part DESC, judge_id DESC, price DESC) = 1) SELECT case_id, date, judge_id, outcome, CAST(conf AS DOUBLE) AS confidence, outcome = 'ADJOURNED' AS adjourned FROM l")
def hearing_upsert(t: Tables) -> DataFrame:
    """One hearing for each case and day, the last record of the day, with the outcome read from its text."""
    last = with_text(t.hearings).groupBy("case_id", "date").agg(F.max(F.struct("line", "part", "judge_id", "price", "text")).alias("h"))
    r = parsed(F.col("h.text"))
    return last.select("case_id", "date", "h.judge_id", r["outcome"].alias("outcome"), r["confidence"].alias("confidence"), (r["outcome"] == "ADJOURNED").alias("adjourned"))


@query("prj_1_case_export", CHOSEN_SQL + " SELECT c.case_id, court, state, case_type, status, filing_date, n_hearings, n_adjourned, round(ratio, 4) AS normalized_delay, severity, round(importance, 4) AS importance FROM case_spans c LEFT JOIN (SELECT case_id, ratio, severity FROM sev) USING (case_id)")
def case_export(t: Tables) -> DataFrame:
    """The data set of cases as it is published: no party, amount or number of a person."""
    found = scored(t).select("case_id", F.round("ratio", 4).alias("normalized_delay"), "severity")
    return t.case_spans.join(found, "case_id", "left").select("case_id", "court", "state", "case_type", "status", "filing_date", "n_hearings", "n_adjourned", "normalized_delay", "severity", F.round("importance", 4).alias("importance"))


@query("prj_1_hearing_export", "SELECT h.case_id, h.date, h.outcome_type, round(h.confidence, 4) AS confidence, h.judge_id FROM hearings h SEMI JOIN (SELECT case_id FROM cases WHERE state = 'ASIA') USING (case_id)")
def hearing_export(t: Tables, state: str = "ASIA") -> DataFrame:
    """The hearings of the cases that a filter picks: a semi join."""
    picked = t.cases.where(F.col("state") == state).select("case_id")
    return t.hearings.join(picked, "case_id", "left_semi").select("case_id", "date", "outcome_type", F.round("confidence", 4).alias("confidence"), "judge_id")


@query("prj_4_comparison", CHOSEN_SQL + " SELECT case_id, delay, level, round(median, 4) AS median, round(ratio, 4) AS ratio, round(pct, 2) AS pct, severity FROM sev")
def comparison(t: Tables) -> DataFrame:
    return scored(t).select("case_id", F.col("delay").cast("long").alias("delay"), "level", F.round("median", 4).alias("median"), F.round("ratio", 4).alias("ratio"), F.round("pct", 2).alias("pct"), "severity")


EXPLAIN_SQL = CHOSEN_SQL + """, ex AS (SELECT c.case_id, list_filter([CASE WHEN n IS NOT NULL THEN least(1, n / 150) END, importance, CASE WHEN pct IS NOT NULL THEN 0.8 END, CASE WHEN ratio IS NOT NULL THEN 0.8 END, CASE WHEN NOT is_disposed THEN 0.7 END], lambda x: x IS NOT NULL) AS parts FROM cases c LEFT JOIN sev USING (case_id))
SELECT case_id, round(CASE WHEN len(parts) = 0 THEN 0.2 ELSE list_sum(parts) / len(parts) END, 3) AS confidence, round(CASE WHEN len(parts) = 0 THEN 0.2 ELSE list_sum(parts) / len(parts) END, 3) < 0.5 AS low_data FROM ex"""


@query("prj_5_explanation", EXPLAIN_SQL)
def explanation(t: Tables) -> DataFrame:
    """The mean of the confidences there are: baseline, importance, percentile, ratio and survival; a note where it is low."""
    found = scored(t).select("case_id", F.least(F.lit(1.0), F.col("n") / 150).alias("sample"), "pct", "ratio")
    joined = t.cases.join(found, "case_id", "left")
    has = lambda c, value: F.when(F.col(c).isNotNull(), F.lit(value))
    parts = F.array_compact(F.array("sample", "importance", has("pct", 0.8), has("ratio", 0.8), F.when(~F.col("is_disposed"), 0.7)))
    mean = F.when(F.size("parts") == 0, 0.2).otherwise(F.aggregate("parts", F.lit(0.0), lambda a, x: a + x) / F.size("parts"))
    return joined.select("case_id", parts.alias("parts")).select("case_id", F.round(mean, 3).alias("confidence")).withColumn("low_data", F.col("confidence") < 0.5)
