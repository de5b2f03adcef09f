"""Ingestion quality: drift, volume, confidence, health, scheduling, storage and upsert (ING, SRC, SNK)."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketlens.functions.numbers import clamp
from docketlens.operators.windows import RUNS_SQL, daily_runs
from docketlens.plans.registry import query
from docketlens.sources.domain import Tables

TAG = r"<([a-zA-Z][a-zA-Z0-9]*)"
TAGS_SQL = f""", tg AS (SELECT page_id, lower(unnest(regexp_extract_all(html, '{TAG}', 1))) AS tag FROM pages), tc AS (SELECT page_id, tag, count(*) AS n FROM tg GROUP BY ALL),
base AS (SELECT tag, median(n) AS b FROM tc GROUP BY 1), pg AS (SELECT page_id FROM pages),
df AS (SELECT pg.page_id, base.tag, coalesce(n, 0) AS n, b FROM pg CROSS JOIN base LEFT JOIN tc ON tc.page_id = pg.page_id AND tc.tag = base.tag)"""


def tag_counts(pages: DataFrame) -> DataFrame:
    tags = F.explode(F.transform(F.regexp_extract_all("html", F.lit(TAG), 1), F.lower))
    return pages.select("page_id", tags.alias("tag")).groupBy("page_id", "tag").agg(F.count(F.lit(1)).alias("n"))


@query("ing_3_html_drift", TAGS_SQL + " SELECT page_id, round(avg(CAST(abs(n - b) > greatest(2, 0.3 * b) AS INT)), 6) AS changed, avg(CAST(abs(n - b) > greatest(2, 0.3 * b) AS INT)) > 0.20 AS drifted FROM df GROUP BY 1")
def html_drift(t: Tables) -> DataFrame:
    """Share of known tags whose count on a page is far from the usual one.

    A tag that a page lacks is far if its usual count is over 2, which is one number for all pages; only the tags a page
    has are looked up. So no page meets all tags of the corpus.
    """
    counts = tag_counts(t.read("pages"))
    base = counts.groupBy("tag").agg(F.median("n").alias("b"))
    all_tags = base.agg(F.count(F.lit(1)).alias("known"), F.count_if(F.col("b") > 2).alias("missed"))
    far = F.abs(F.col("n") - F.col("b")) > F.greatest(F.lit(2.0), 0.3 * F.col("b"))
    seen = counts.join(base, "tag").groupBy("page_id").agg(F.count_if(far).alias("far"), F.count_if(F.col("b") > 2).alias("usual"))
    share = (F.col("far") + F.col("missed") - F.col("usual")) / F.col("known")
    return seen.join(all_tags, F.lit(True)).select("page_id", F.round(share, 6).alias("changed"), (share > 0.20).alias("drifted"))


@query("ing_4_json_drift", "SELECT event_id, round(len(list_filter(list_distinct(list_concat(json_keys(props), ['k', 'source'])), lambda x: NOT (list_contains(json_keys(props), x) AND list_contains(['k', 'source'], x)))) / len(list_distinct(list_concat(json_keys(props), ['k', 'source']))), 6) AS drift FROM events")
def json_drift(t: Tables, expected=("k", "source")) -> DataFrame:
    """Keys that only one of record and expectation has, by all keys of both."""
    keys, known = F.json_object_keys("props"), F.array(*[F.lit(k) for k in expected])
    both = F.array_union(keys, known)
    return t.read("events").select("event_id", F.round((F.size(both) - F.size(F.array_intersect(keys, known))) / F.size(both), 6).alias("drift"))


VOLUME_SQL = RUNS_SQL + ", vm AS (SELECT *, median(n) OVER (PARTITION BY source ORDER BY day ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS m FROM runs)"


def volume_label(n: Column, median: Column, margin: float) -> Column:
    return F.when(median.isNull(), "no_history").when(median == 0, F.when(n > 0, "spike").otherwise("none")).when(n > median * (1 + margin), "spike").when(n < median * (1 - margin), "drop").otherwise("none")


def volumes(t: Tables, last: int = 10) -> DataFrame:
    frame = Window.partitionBy("source").orderBy("day").rowsBetween(-last, -1)
    return daily_runs(t).withColumn("m", F.percentile("n", F.lit(0.5)).over(frame))


@query("ing_6_volume", VOLUME_SQL + " SELECT source, day, n, round(CASE WHEN m IS NULL THEN NULL WHEN m = 0 THEN 1 ELSE n / m END, 4) AS ratio, CASE WHEN m IS NULL THEN 'no_history' WHEN m = 0 THEN CASE WHEN n > 0 THEN 'spike' ELSE 'none' END WHEN n > m * 1.1 THEN 'spike' WHEN n < m * 0.9 THEN 'drop' ELSE 'none' END AS anomaly FROM vm")
def volume(t: Tables, margin: float = 0.1) -> DataFrame:
    ratio = F.when(F.col("m") == 0, 1.0).otherwise(F.col("n") / F.nullif("m", F.lit(0.0)))
    return volumes(t).select("source", "day", "n", F.round(ratio, 4).alias("ratio"), volume_label(F.col("n"), F.col("m"), margin).alias("anomaly"))


@query("ing_7_parser_confidence", "SELECT event_type, round(least(1, greatest(0, 0.25 + 0.35 * count(value) / count(*) + 0.25 * (1 - count(*) FILTER (value < 5) / count(*)) + 0.15 * count(*) FILTER (props LIKE '{%') / count(*))), 4) AS confidence FROM events GROUP BY 1")
def parser_confidence(t: Tables) -> DataFrame:
    """Presence, completeness, share without errors and type validity of a source's records."""
    n = F.count(F.lit(1))
    c = 0.25 + 0.35 * F.count("value") / n + 0.25 * (1 - F.count_if(F.col("value") < 5) / n) + 0.15 * F.count_if(F.col("props").startswith("{")) / n
    return t.read("events").groupBy("event_type").agg(F.round(clamp(c), 4).alias("confidence"))


STATUS_SQL = """, st AS (SELECT event_type AS source, CAST(ts AS DATE) AS day, CASE WHEN count(*) FILTER (value < 5) <= 0.05 * count(*) THEN 'SUCCESS' WHEN count(*) FILTER (value < 5) <= 0.12 * count(*) THEN 'PARTIAL' ELSE 'FAILED' END AS status FROM events GROUP BY ALL),
isl AS (SELECT *, count(*) FILTER (status = 'SUCCESS') OVER (PARTITION BY source ORDER BY day) AS island FROM st),
fc AS (SELECT *, count(*) FILTER (status <> 'SUCCESS') OVER (PARTITION BY source, island ORDER BY day) AS failures FROM isl)"""


def run_states(t: Tables) -> DataFrame:
    """Runs with the number of failures since the last success: the successes so far number the islands."""
    n, bad = F.count(F.lit(1)), F.count_if(F.col("value") < 5)
    status = F.when(bad <= 0.05 * n, "SUCCESS").when(bad <= 0.12 * n, "PARTIAL").otherwise("FAILED")
    runs = t.read("events").groupBy(F.col("event_type").alias("source"), F.to_date("ts").alias("day")).agg(status.alias("status"))
    island = F.count_if(F.col("status") == "SUCCESS").over(Window.partitionBy("source").orderBy("day"))
    return runs.withColumn("island", island).withColumn("failures", F.count_if(F.col("status") != "SUCCESS").over(Window.partitionBy("source", "island").orderBy("day")))


@query("ing_8_health", STATUS_SQL + " SELECT source, day, status, failures, CASE WHEN failures = 0 THEN 'HEALTHY' WHEN failures >= 3 THEN 'FAILED' ELSE 'DEGRADED' END AS health FROM fc")
def health(t: Tables, threshold: int = 3) -> DataFrame:
    state = F.when(F.col("failures") == 0, "HEALTHY").when(F.col("failures") >= threshold, "FAILED").otherwise("DEGRADED")
    return run_states(t).select("source", "day", "status", "failures", state.alias("health"))


@query("ing_9_sweep", STATUS_SQL + " SELECT source, max(day) AS last_day, arg_max(failures, day) AS failures, date_diff('day', max(day), DATE '2024-02-01') > 1 AS stale, arg_max(failures, day) >= 3 AS failing FROM fc GROUP BY 1")
def sweep(t: Tables, as_of: str = "2024-02-01") -> DataFrame:
    last = F.max_by("failures", "day")
    return run_states(t).groupBy("source").agg(F.max("day").alias("last_day"), last.alias("failures"), (F.datediff(F.lit(as_of).cast("date"), F.max("day")) > 1).alias("stale"), (last >= 3).alias("failing"))


@query("ing_10_due", STATUS_SQL + " SELECT source, DATE '2024-02-01' >= max(day) + CAST(CASE WHEN arg_max(failures, day) >= 3 THEN least(8, pow(2, arg_max(failures, day))) ELSE 1 END AS INTEGER) AS due FROM fc GROUP BY 1")
def due(t: Tables, as_of: str = "2024-02-01", threshold: int = 3, cap: int = 8) -> DataFrame:
    """A failing source waits twice as long for every failure, up to a cap."""
    last = F.max_by("failures", "day")
    wait = F.when(last >= threshold, F.least(F.lit(float(cap)), F.pow(F.lit(2.0), last))).otherwise(1.0).cast("int")
    return run_states(t).groupBy("source").agg((F.lit(as_of).cast("date") >= F.date_add(F.max("day"), wait)).alias("due"))


@query("ing_13_normalised", "SELECT o_orderkey AS case_id, coalesce(nullif(trim(o_orderpriority), ''), 'Unknown') AS stage, lower(o_orderstatus) AS status, CAST(coalesce(year(o_orderdate), 0) AS INTEGER) AS filing_year FROM orders")
def normalised(t: Tables) -> DataFrame:
    return t.read("orders").select(F.col("o_orderkey").alias("case_id"), F.coalesce(F.nullif(F.trim("o_orderpriority"), F.lit("")), F.lit("Unknown")).alias("stage"), F.lower("o_orderstatus").alias("status"), F.coalesce(F.year("o_orderdate"), F.lit(0)).alias("filing_year"))


def waits(base_minutes: int = 60, cap_minutes: int = 960) -> list[int]:
    """Minutes of wait after each alert that one day can have sent but for the last."""
    found, total = [], 0
    while total + (wait := min(cap_minutes, base_minutes * 2 ** len(found))) < 1440:
        found.append(wait)
        total += wait
    return found


def _alerts_sql() -> str:
    parts = ["b AS (SELECT event_type, CAST(ts AS DATE) AS day, ts FROM events WHERE value < 5)", "s0 AS (SELECT event_type, day, count(*) AS alerts, min(ts) AS last FROM b GROUP BY ALL)"]
    parts += [f"s{i + 1} AS (SELECT s.event_type, s.day, min(b.ts) AS last FROM s{i} s JOIN b ON b.event_type = s.event_type AND b.day = s.day AND b.ts >= s.last + INTERVAL {w} MINUTE GROUP BY ALL)" for i, w in enumerate(waits())]
    sent = " + ".join(f"(SELECT count(*) FROM s{i} x WHERE x.event_type = s0.event_type AND x.day = s0.day)" for i in range(len(waits()) + 1))
    return ", " + ", ".join(parts) + f" SELECT event_type, day, alerts, {sent} AS sent FROM s0"


@query("ing_15_alert_suppression", _alerts_sql())
def alert_suppression(t: Tables, base_minutes: int = 60, cap_minutes: int = 960) -> DataFrame:
    """Alerts of a source that are sent on a day: the wait doubles after each one sent.

    A day has room for few alerts, as their waits double; each is the first one after the wait, an aggregate over the
    alerts of the day. So no task gathers a source's alerts.
    """
    alerts = t.read("events").where("value < 5").select("event_type", F.to_date("ts").alias("day"), F.col("ts").cast("timestamp").alias("ts"))
    state = alerts.groupBy("event_type", "day").agg(F.count(F.lit(1)).alias("alerts"), F.min("ts").alias("last")).withColumn("sent", F.lit(1).cast("long"))
    for wait in waits(base_minutes, cap_minutes):
        later = alerts.join(state.select("event_type", "day", "last"), ["event_type", "day"]).where(F.col("ts") >= F.col("last") + F.make_dt_interval(mins=F.lit(wait)))
        following = later.groupBy("event_type", "day").agg(F.min("ts").alias("next"))
        state = state.join(following, ["event_type", "day"], "left").select("event_type", "day", "alerts", "next", (F.col("sent") + F.col("next").isNotNull().cast("long")).alias("sent")).withColumnRenamed("next", "last")
    return state.select("event_type", "day", "alerts", "sent")


@query("src_8_content_store", "SELECT min(page_id) AS page_id, sha256(html) AS checksum, 'raw/' || left(sha256(html), 2) || '/' || sha256(html) AS key, count(*) AS copies FROM pages GROUP BY sha256(html)")
def content_store(t: Tables) -> DataFrame:
    """Each payload once, under the key of its checksum; the first page keeps it."""
    sums = t.read("pages").select("page_id", F.sha2("html", 256).alias("checksum"))
    g = sums.groupBy("checksum").agg(F.min("page_id").alias("page_id"), F.count(F.lit(1)).alias("copies"))
    return g.select("page_id", "checksum", F.concat(F.lit("raw/"), F.left("checksum", F.lit(2)), F.lit("/"), F.col("checksum")).alias("key"), "copies")


@query("src_9_tiers", "SELECT CASE WHEN a < 30 THEN 'hot' WHEN a < 90 THEN 'warm' ELSE 'cold' END AS tier, count(*) AS n, count(*) FILTER (a >= 30) AS compressed FROM (SELECT date_diff('day', CAST(o_orderdate AS DATE), DATE '2001-08-31') AS a FROM orders) GROUP BY 1")
def tiers(t: Tables, as_of: str = "2001-08-31") -> DataFrame:
    age = F.datediff(F.lit(as_of).cast("date"), F.to_date("o_orderdate"))
    tier = F.when(F.col("a") < 30, "hot").when(F.col("a") < 90, "warm").otherwise("cold")
    return t.read("orders").select(age.alias("a")).groupBy(tier.alias("tier")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("a") >= 30).alias("compressed"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """old with new merged in by keys; of several new rows of a key the last by order wins."""
    last = new.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(order.desc()))).where("__rn = 1").drop("__rn")
    return last.unionByName(old.join(last.select(*keys), keys, "left_anti"))


@query("snk_1_upsert", "SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders UNION ALL SELECT o_orderkey + 100000000, 'N' FROM orders WHERE o_orderkey % 1000 = 0")
def upsert_query(t: Tables) -> DataFrame:
    old = t.read("orders").select("o_orderkey", "o_orderstatus")
    changed = old.where("o_orderkey % 10 = 0").withColumn("o_orderstatus", F.lit("X"))
    added = old.where("o_orderkey % 1000 = 0").select((F.col("o_orderkey") + 100_000_000).alias("o_orderkey"), F.lit("N").alias("o_orderstatus"))
    return upsert(old, changed.unionByName(added), ["o_orderkey"], F.col("o_orderstatus"))


@query("cst_1_storage_cost", "SELECT round(sum(length(html)) / 1e9 * 0.5 * 0.023 + sum(length(html)) / 1e9 * 0.3 * 0.0125 + sum(length(html)) / 1e9 * 0.2 * 0.004, 9) AS monthly FROM pages")
def storage_cost(t: Tables, shares=((0.5, 0.023), (0.3, 0.0125), (0.2, 0.004))) -> DataFrame:
    gb = F.sum(F.length("html")) / 1e9
    return t.read("pages").agg(F.round(sum((gb * s * p for s, p in shares[1:]), gb * shares[0][0] * shares[0][1]), 9).alias("monthly"))
