"""Provenance of field values and timelines (PRV, INV). Events stand in for recorded values of a user's fields."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docketlens.functions.numbers import clamp
from docketlens.operators.delay import CHOSEN_SQL as DELAY_SQL
from docketlens.operators.delay import baseline_confidence, scored
from docketlens.operators.importance import COMPONENTS_SQL, case_confidence, components
from docketlens.plans.lineage import ancestors
from docketlens.plans.registry import query
from docketlens.sources.domain import Tables

#: Weights of source types, 0.5 for the others.
TYPE_WEIGHTS = {"API": 1.0, "PDF": 0.92, "HTML": 0.82, "MANUAL": 0.7}
KINDS = ("API", "PDF", "HTML", "MANUAL", "FAX")

PROV_SQL = """, prov AS (SELECT event_id, user_id AS entity_id, event_type AS field, regexp_extract(props, '(-?\\d+)', 1) AS value, list_extract(['API', 'PDF', 'HTML', 'MANUAL', 'FAX'], CAST(event_id % 5 AS INTEGER) + 1) AS source_type,
  least(1, greatest(0, value / 100)) AS confidence, ts AS fetched, event_id % 7 = 0 AS is_primary, CASE WHEN event_id % 3 = 0 THEN 'District Court' ELSE 'registry' END AS source_name FROM events),
hashed AS (SELECT *, sha256('{"k":' || value || '}') AS hash FROM prov)"""


def records(t: Tables) -> DataFrame:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return t.read("events").select("event_id", F.col("user_id").alias("entity_id"), F.col("event_type").alias("field"), F.get_json_object("props", "$.k").alias("value"), F.get(kinds, (F.col("event_id") % 5).cast("int")).alias("source_type"), clamp(F.col("value") / 100).alias("confidence"), F.col("ts").alias("fetched"), (F.col("event_id") % 7 == 0).alias("is_primary"), F.when(F.col("event_id") % 3 == 0, "District Court").otherwise("registry").alias("source_name"))


def hashed(t: Tables) -> DataFrame:
    """Values with the hash of their canonical JSON."""
    return records(t).withColumn("hash", F.sha2(F.to_json(F.struct(F.col("value").cast("long").alias("k"))), 256))


@query("prv_1_value_hash", PROV_SQL + " SELECT event_id, hash FROM hashed")
def value_hash(t: Tables) -> DataFrame:
    return hashed(t).select("event_id", "hash")


def rank_of(confidence, source_type, age_days, source_name):
    """Confidence, kind and age of a source, and a little more for a court."""
    weight = F.coalesce(F.create_map(*[x for k, v in TYPE_WEIGHTS.items() for x in (F.lit(k), F.lit(v))])[source_type], F.lit(0.5))
    return 0.7 * confidence + 0.25 * weight + F.greatest(F.lit(0.0), 0.25 - F.least(F.lit(0.25), age_days / 365)) + F.when(F.lower(source_name).contains("court"), 0.05).otherwise(0.0)


@query("prv_2_rank", PROV_SQL + " SELECT event_id, round(0.7 * confidence + 0.25 * CASE source_type WHEN 'API' THEN 1 WHEN 'PDF' THEN 0.92 WHEN 'HTML' THEN 0.82 WHEN 'MANUAL' THEN 0.7 ELSE 0.5 END + greatest(0, 0.25 - least(0.25, date_diff('day', CAST(fetched AS DATE), DATE '2024-02-01') / 365)) + CASE WHEN lower(source_name) LIKE '%court%' THEN 0.05 ELSE 0 END, 6) AS rank FROM prov")
def ranks(t: Tables) -> DataFrame:
    age = F.datediff(F.lit("2024-02-01").cast("date"), F.to_date("fetched"))
    return records(t).select("event_id", F.round(rank_of(F.col("confidence"), F.upper("source_type"), age, F.col("source_name")), 6).alias("rank"))


@query("prv_3_conflicts", PROV_SQL + " SELECT entity_id, field, count(*) AS n, count(DISTINCT hash) AS versions FROM hashed GROUP BY ALL HAVING count(DISTINCT hash) > 1")
def conflicts(t: Tables) -> DataFrame:
    return hashed(t).groupBy("entity_id", "field").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("hash").alias("versions")).where("versions > 1")


@query(
    "prv_3_links",
    PROV_SQL + """, v AS (SELECT entity_id, field, hash, count(*) AS members, arg_max(event_id, (is_primary, confidence, fetched, event_id)) AS representative FROM hashed GROUP BY ALL)
    SELECT *, CAST(sum(members) OVER w - members AS BIGINT) AS others, CAST(members * (sum(members) OVER w - members) AS BIGINT) AS links FROM v WINDOW w AS (PARTITION BY entity_id, field) QUALIFY count(*) OVER w > 1""",
)
def conflict_links(t: Tables) -> DataFrame:
    """The pairs of records in conflict, without making them: one row for each version of a field that has several.

    A version has its best record as representative, its members, and the records of other versions, each of which conflicts with each
    member: links is the number of those pairs, and every pair is that of two rows' members. Members are counted before the totals.
    """
    best = F.max_by("event_id", F.struct("is_primary", "confidence", "fetched", "event_id"))
    version = hashed(t).groupBy("entity_id", "field", "hash").agg(F.count(F.lit(1)).alias("members"), best.alias("representative"))
    total = version.groupBy(F.col("entity_id").alias("e"), F.col("field").alias("f")).agg(F.sum("members").alias("total"), F.count(F.lit(1)).alias("versions")).where("versions > 1")
    joined = version.join(total, F.col("entity_id").eqNullSafe(F.col("e")) & F.col("field").eqNullSafe(F.col("f")))
    others = F.col("total") - F.col("members")
    return joined.select("entity_id", "field", "hash", "members", "representative", others.alias("others"), (F.col("members") * others).alias("links"))


BEST = "is_primary DESC, confidence DESC, fetched DESC, event_id DESC"


@query("prv_4_primary", PROV_SQL + f" SELECT entity_id, field, event_id, value FROM hashed QUALIFY row_number() OVER (PARTITION BY entity_id, field ORDER BY {BEST}) = 1")
def primary(t: Tables) -> DataFrame:
    """The best record of each field as the largest struct: an aggregate that combines before the shuffle, no window."""
    best = F.max_by(F.struct("event_id", "value"), F.struct("is_primary", "confidence", "fetched", "event_id"))
    return records(t).groupBy("entity_id", "field").agg(best.alias("b")).select("entity_id", "field", "b.event_id", "b.value")


@query("win_12_primary_window", PROV_SQL + f" SELECT entity_id, field, event_id FROM hashed QUALIFY row_number() OVER (PARTITION BY entity_id, field ORDER BY {BEST}) = 1")
def primary_window(t: Tables) -> DataFrame:
    order = Window.partitionBy("entity_id", "field").orderBy(F.desc("is_primary"), F.desc("confidence"), F.desc_nulls_last("fetched"), F.desc("event_id"))
    return records(t).withColumn("rn", F.row_number().over(order)).where("rn = 1").select("entity_id", "field", "event_id")


@query("prv_5_as_of", PROV_SQL + " SELECT entity_id, field, arg_max(value, (is_primary, confidence, fetched, event_id)) AS value FROM hashed WHERE fetched <= TIMESTAMP '2024-01-15 00:00:00' GROUP BY ALL")
def as_of(t: Tables, at: str = "2024-01-15 00:00:00") -> DataFrame:
    known = records(t).where(F.col("fetched") <= F.lit(at).cast("timestamp_ntz"))
    return known.groupBy("entity_id", "field").agg(F.max_by("value", F.struct("is_primary", "confidence", "fetched", "event_id")).alias("value"))


STEP = "array<struct<op:string,value:string,output_value:string>>"
STEPS_SQL = """, steps AS (SELECT *, CASE event_id % 4 WHEN 0 THEN value WHEN 1 THEN value || '0' WHEN 2 THEN value END AS replayed FROM hashed)"""


def transformed(t: Tables) -> DataFrame:
    """Records with the steps by which their value came about. The tables have none: they follow from numbers.

    By number: fetched as it is; fetched, then scaled by ten; scaled, fetched again, then checked, which puts out nothing; checked alone.
    """
    step = lambda op, value=None, out=None: F.struct(F.lit(op).alias("op"), (F.lit(None) if value is None else value).cast("string").alias("value"), (F.lit(None) if out is None else out).cast("string").alias("output_value"))
    v, n = F.col("value"), F.col("event_id") % 4
    fetched, scaled, checked = step("fetch", v), step("scale", v, F.concat(v, F.lit("0"))), step("check")
    steps = F.when(n == 0, F.array(fetched)).when(n == 1, F.array(fetched, scaled)).when(n == 2, F.array(scaled, fetched, checked)).otherwise(F.array(checked))
    return hashed(t).withColumn("steps", steps.cast(STEP))


def replayed(steps):
    """The value after the last step that has one; within a step its output comes before its value. Null without steps or values."""
    return F.aggregate(F.coalesce(steps, F.array().cast(STEP)), F.lit(None).cast("string"), lambda value, s: F.coalesce(s["output_value"], s["value"], value))


@query(
    "prv_5_replay",
    PROV_SQL + STEPS_SQL + " SELECT entity_id, field, arg_max(event_id, (is_primary, confidence, fetched, event_id)) AS record, arg_max(coalesce(replayed, 'none'), (is_primary, confidence, fetched, event_id)) AS state FROM steps WHERE fetched <= TIMESTAMP '2024-01-15 00:00:00' GROUP BY ALL",
)
def replay(t: Tables, at: str = "2024-01-15 00:00:00") -> DataFrame:
    """The state of every field at a time: the best record known then, and what its steps lead to, or none."""
    known = transformed(t).where(F.col("fetched") <= F.lit(at).cast("timestamp_ntz")).select("entity_id", "field", "event_id", "is_primary", "confidence", "fetched", replayed(F.col("steps")).alias("state"))
    best = known.groupBy("entity_id", "field").agg(F.max_by(F.struct("event_id", "state"), F.struct("is_primary", "confidence", "fetched", "event_id")).alias("b"))
    return best.select("entity_id", "field", F.col("b.event_id").alias("record"), F.coalesce("b.state", F.lit("none")).alias("state"))


@query("prv_6_lineage", "SELECT event_id AS node, CAST(floor(log2(event_id + 1)) AS BIGINT) AS ancestors FROM events")
def lineage(t: Tables) -> DataFrame:
    """The number of ancestors of every record, where record n comes from record (n - 1) div 2."""
    parent = F.when(F.col("event_id") > 0, F.floor((F.col("event_id") - 1) / 2))
    return ancestors(t.read("events").select(F.col("event_id").alias("node"), parent.alias("parent"))).select("node", F.col("distance").alias("ancestors"))


@query("join_16_roots", "SELECT CAST(floor((event_id + 1) / pow(2, greatest(0, floor(log2(event_id + 1)) - 3))) - 1 AS BIGINT) AS top, count(*) AS nodes, CAST(max(greatest(0, floor(log2(event_id + 1)) - 3)) AS BIGINT) AS deepest FROM events GROUP BY 1")
def roots(t: Tables) -> DataFrame:
    """Trees of records whose first fifteen records have no parent: each tree's top, its records and its depth."""
    n = F.col("event_id")
    found = ancestors(t.read("events").select(n.alias("node"), F.when(n >= 15, F.floor((n - 1) / 2)).alias("parent")))
    return found.groupBy(F.coalesce("top", "node").alias("top")).agg(F.count(F.lit(1)).alias("nodes"), F.max("distance").alias("deepest"))


@query("prv_7_listing", PROV_SQL + " SELECT event_id, fetched FROM hashed WHERE source_type = 'PDF' ORDER BY fetched DESC, event_id DESC LIMIT 200")
def listing(t: Tables, limit: int = 200) -> DataFrame:
    return records(t).where("source_type = 'PDF'").select("event_id", "fetched").orderBy(F.desc("fetched"), F.desc("event_id")).limit(limit)


TIMELINE_SQL = """, p AS (SELECT case_id, date, outcome_type, linestatus, judge_id, lag(judge_id) OVER (PARTITION BY case_id ORDER BY date, line, part, judge_id, price) AS before FROM hearings),
tl AS (SELECT case_id, filing_date AS date, 'FILING' AS kind FROM cases UNION ALL SELECT case_id, date, CASE outcome_type WHEN 'ADJOURNED' THEN 'ADJOURNMENT' WHEN 'DISPOSED' THEN 'DISPOSAL' ELSE 'HEARING' END FROM p
  UNION ALL SELECT case_id, date, 'JUDGE_CHANGE' FROM p WHERE before IS NOT NULL AND judge_id <> before UNION ALL SELECT case_id, date, 'ORDER' FROM p WHERE linestatus = 'O')"""


def timeline(t: Tables) -> DataFrame:
    """Filing, hearings, changes of judge and orders of each case; one window over the hearings serves three branches."""
    w = Window.partitionBy("case_id").orderBy("date", "line", "part", "judge_id", "price")
    p = t.hearings.withColumn("before", F.lag("judge_id").over(w))
    kind = F.when(F.col("outcome_type") == "ADJOURNED", "ADJOURNMENT").when(F.col("outcome_type") == "DISPOSED", "DISPOSAL").otherwise("HEARING")
    kinds = F.array_compact(F.array(kind, F.when(F.col("before").isNotNull() & (F.col("judge_id") != F.col("before")), "JUDGE_CHANGE"), F.when(F.col("linestatus") == "O", "ORDER")))
    filed = t.cases.select("case_id", F.col("filing_date").alias("date"), F.lit("FILING").alias("kind"))
    return filed.unionByName(p.select("case_id", "date", F.explode(kinds).alias("kind"))).where("date IS NOT NULL")


@query("inv_1_timeline", TIMELINE_SQL + " SELECT case_id, date, kind, count(*) AS n FROM tl WHERE date IS NOT NULL GROUP BY ALL")
def timeline_query(t: Tables) -> DataFrame:
    return timeline(t).groupBy("case_id", "date", "kind").agg(F.count(F.lit(1)).alias("n"))


INV_SQL = (
    DELAY_SQL
    + COMPONENTS_SQL
    + """, oc AS (SELECT case_id, count(*) FILTER (linestatus = 'O') AS orders FROM hearings GROUP BY 1),
    bco AS (SELECT case_id, least(1, greatest(0, (0.45 * least(1, n / 150) + 0.25 * greatest(0.2, 1 - 30 / 3650) + 0.30 * CASE WHEN median <= 0 THEN 0.4 ELSE greatest(0.2, 1 - least(1, iqr / greatest(1, median))) END) * greatest(0.5, 1 - 0.08 * depth))) AS bc, median, p75, n AS sample, level FROM chosen),
    ico AS (SELECT case_id, least(1, greatest(0.2, (0.75 * signals / 4 + 0.25 * exp(-date_diff('day', filing_date, DATE '2001-12-31') / 180)) * CASE WHEN capped THEN 0.85 ELSE 1 END * CASE WHEN signals < 2 THEN 0.5 ELSE 1 END)) AS ic FROM imp)
    SELECT c.case_id, CASE WHEN is_disposed THEN coalesce(date_diff('day', filing_date, disposal_date), date_diff('day', filing_date, DATE '2001-12-31')) ELSE date_diff('day', filing_date, DATE '2001-12-31') END AS duration_days,
      b.level AS baseline_level, round(b.median, 2) AS baseline_median, round(b.p75, 2) AS baseline_p75, b.sample AS baseline_sample,
      round((coalesce(bc, 0) + coalesce(ic, 0) + least(1, n_hearings / 20) + least(1, coalesce(orders, 0) / 10)) / 4, 3) AS confidence
    FROM case_spans c LEFT JOIN bco b USING (case_id) LEFT JOIN ico USING (case_id) LEFT JOIN oc USING (case_id)"""
)


@query("inv_2_metrics", INV_SQL)
def metrics(t: Tables) -> DataFrame:
    """Duration, the baseline it is held against, and the mean of four confidences: baseline, importance, hearings, orders."""
    one = F.lit(1.0)
    age = F.datediff(t.as_of, "filing_date")
    days = F.when(F.col("is_disposed"), F.coalesce(F.datediff("disposal_date", "filing_date"), age)).otherwise(age).cast("long")
    base = scored(t).select("case_id", baseline_confidence(F.col("n"), F.lit(30.0), F.col("median"), F.col("iqr"), F.col("depth")).alias("bc"), "level", "median", "p75", F.col("n").alias("sample"))
    importance = components(t).select("case_id", case_confidence(t.as_of).alias("ic"))
    orders = t.hearings.where("linestatus = 'O'").groupBy("case_id").agg(F.count(F.lit(1)).alias("orders"))
    joined = t.case_spans.join(base, "case_id", "left").join(importance, "case_id", "left").join(orders, "case_id", "left")
    total = F.coalesce("bc", F.lit(0.0)) + F.coalesce("ic", F.lit(0.0)) + F.least(one, F.col("n_hearings") / 20) + F.least(one, F.coalesce("orders", F.lit(0)) / 10)
    return joined.select("case_id", days.alias("duration_days"), F.col("level").alias("baseline_level"), F.round("median", 2).alias("baseline_median"), F.round("p75", 2).alias("baseline_p75"), F.col("sample").alias("baseline_sample"), F.round(total / 4, 3).alias("confidence"))


@query(
    "inv_3_versions",
    PROV_SQL + ", v AS (SELECT *, lag(hash) OVER w IS DISTINCT FROM hash AS fresh FROM hashed WINDOW w AS (PARTITION BY entity_id, field ORDER BY fetched, event_id)) SELECT event_id, CAST(sum(CAST(fresh AS INT)) OVER (PARTITION BY entity_id, field ORDER BY fetched, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS version FROM v",
)
def versions(t: Tables) -> DataFrame:
    """A new version only where the hash changes: a running count of changes."""
    w = Window.partitionBy("entity_id", "field").orderBy("fetched", "event_id")
    fresh = (~F.lag("hash").over(w).eqNullSafe(F.col("hash"))).cast("long")
    return hashed(t).withColumn("fresh", fresh).select("event_id", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("version"))
