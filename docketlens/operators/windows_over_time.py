"""The batch forms of the streaming windows, and streams that are run to their end (STR)."""

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketlens.operators.quality import STATUS_SQL, run_states
from docketlens.plans.lineage import shared_folder, ship
from docketlens.plans.registry import query
from docketlens.sources.domain import Tables
from docketlens.streaming import jobs


@query("str_1_tumbling", "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def tumbling(t: Tables) -> DataFrame:
    return jobs.run_counts(t.read("events")).select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n")


@query("str_2_sliding", "SELECT strftime(date_trunc('day', ts) - INTERVAL 1 DAY * d, '%Y-%m-%d %H:%M:%S') AS start, user_id, count(*) AS n FROM events, range(7) r(d) GROUP BY ALL")
def sliding(t: Tables) -> DataFrame:
    return jobs.sliding_counts(t.read("events")).select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "user_id", "n")


@query(
    "str_3_sessions",
    """, e AS (SELECT user_id, ts, coalesce(ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR, true) AS fresh FROM events), s AS (SELECT *, sum(CAST(fresh AS INT)) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
    SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, strftime(max(ts) + INTERVAL 6 HOUR, '%Y-%m-%d %H:%M:%S') AS "end", count(*) AS n FROM s GROUP BY user_id, k""",
)
def sessions(t: Tables) -> DataFrame:
    s = jobs.sessions(t.read("events"))
    return s.select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), F.date_format("end", "yyyy-MM-dd HH:mm:ss").alias("end"), "n")


def _folder(t: Tables) -> str:
    return f"{shared_folder(t.spark)}/stream-{uuid.uuid4().hex}"


@query("str_4_health", STATUS_SQL + " SELECT source, day, failures, CASE WHEN failures = 0 THEN 'HEALTHY' WHEN failures >= 3 THEN 'FAILED' ELSE 'DEGRADED' END AS health FROM fc")
def streamed_health(t: Tables, stretches: int = 4) -> DataFrame:
    """The health of each source after each of its runs, from a stream of runs that a state machine follows over several micro-batches.

    The runs are dealt into stretches of days, one file each, so that the stream gets them in order. The state is in the
    state store and the checkpoint in the shared folder; rows equal those of ing_8.
    """
    ship(t.spark)
    runs = run_states(t).select(F.col("source").alias("event_type"), F.unix_date("day").cast("long").alias("event_id"), F.col("day").cast("timestamp").alias("ts"), F.when(F.col("status") == "SUCCESS", 10.0).otherwise(0.0).alias("value"))
    first, last = runs.agg(F.min("event_id"), F.max("event_id")).first()
    folder = _folder(t)
    cuts = [first + (last + 1 - first) * i // stretches for i in range(stretches + 1)] if first is not None else [0, 1]
    parts = [runs.where((F.col("event_id") >= a) & (F.col("event_id") < b)).coalesce(1) for a, b in zip(cuts, cuts[1:], strict=False)]
    with jobs.session_conf(t.spark, spark__sql__streaming__stateStore__providerClass="org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"):
        out = jobs.drained(jobs.health(jobs.in_stretches(parts, f"{folder}/in")), folder)
    return out.select("source", F.date_from_unix_date(F.col("event_id").cast("int")).alias("day"), "failures", "health")


@query("str_5_dedupe", "SELECT DISTINCT sha256(html) AS checksum, 'raw/' || left(sha256(html), 2) || '/' || sha256(html) AS key FROM pages")
def streamed_dedupe(t: Tables) -> DataFrame:
    """Each payload of a stream of pages that comes twice is stored once, under the key of its checksum, as in src_8."""
    folder = _folder(t)
    pages = t.read("pages").select(F.sha2("html", 256).alias("checksum"), F.lit("2024-01-01").cast("timestamp").alias("ts"))
    out = jobs.drained(jobs.first_seen(jobs.in_stretches([pages, pages], f"{folder}/in"), ["checksum"]).select("checksum"), folder)
    return out.select("checksum", F.concat(F.lit("raw/"), F.left("checksum", F.lit(2)), F.lit("/"), F.col("checksum")).alias("key"))


@query("str_6_upsert", "SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders UNION ALL SELECT o_orderkey + 100000000, 'N' FROM orders WHERE o_orderkey % 1000 = 0")
def streamed_upsert(t: Tables) -> DataFrame:
    """A stream of orders, then of changes and additions to them, that micro-batches merge into a table; rows equal those of snk_1."""
    folder = _folder(t)
    old = t.read("orders").select("o_orderkey", "o_orderstatus", F.lit(0).alias("version"))
    changed = old.where("o_orderkey % 10 = 0").select("o_orderkey", F.lit("X").alias("o_orderstatus"), F.lit(1).alias("version"))
    added = old.where("o_orderkey % 1000 = 0").select((F.col("o_orderkey") + 100_000_000).alias("o_orderkey"), F.lit("N").alias("o_orderstatus"), F.lit(1).alias("version"))
    done: list[int] = []
    stream = jobs.in_stretches([old, changed.unionByName(added)], f"{folder}/in").drop("part")
    merge = jobs.upsert_to(f"{folder}/table", ["o_orderkey"], "version", done)
    stream.writeStream.foreachBatch(merge).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.parquet(f"{folder}/table/v{max(done)}").select("o_orderkey", "o_orderstatus")
