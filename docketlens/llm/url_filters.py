"""URL filters by a temporal list join.

A list has dated entries (pattern, listed_at, action), where action adds the pattern to the list or removes it. The
entries of a pattern, in order of their dates, become intervals in which it is listed. A capture is blocked if at
its fetch time an interval of one of its patterns holds: its host and leading path segments, its host, or a parent
domain of two labels or more. All patterns of a distinct host, path and time are looked up in one as-of join; the
intervals of a pattern do not overlap, so each pattern has one match at most, and the most specific one counts.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketlens.llm.common import bounded_broadcast, checkpoint

#: Open ends of intervals.
FOREVER = "9999-12-31 00:00:00"


def host_of(url: Column) -> Column:
    """Host in lower case, without user and port; empty where there is none."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1))


def patterns_of(url: Column) -> dict[str, Column]:
    host = host_of(url)
    segment = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+/([^/?#]+)", 1)
    return {"path": F.concat(host, F.lit("/"), segment), "host": host, "domain": F.regexp_extract(host, r"([^.]+\.[^.]+\.[^.]+)$", 1)}


def lookups(url: Column) -> Column:
    """All patterns of a URL as (by, pattern), most specific first: paths from the longest, the host, its parent domains."""
    of = patterns_of(url)
    host = of["host"]
    rest = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+/([^?#]*)", 1)
    segments, labels = F.split(F.rtrim(rest, F.lit("/")), "/"), F.split(host, r"\.")
    pair = lambda by, pattern: F.struct(F.lit(by).alias("by"), pattern.alias("pattern"))
    down = lambda high, low, body: F.when(high >= low, F.transform(F.sequence(high, F.lit(low), F.lit(-1)), body)).otherwise(F.array())
    longer = down(F.size(segments), 2, lambda k: pair("path", F.concat(host, F.lit("/"), F.array_join(F.slice(segments, 1, k), "/"))))
    parents = down(F.when(host.rlike(r"^[0-9.]+$"), F.lit(0)).otherwise(F.size(labels) - 1), 2, lambda k: pair("domain", F.array_join(F.slice(labels, -k, k), ".")))
    return F.when(host != "", F.concat(longer, F.array(pair("path", of["path"]), pair("host", host)), parents))


def intervals(entries: DataFrame) -> DataFrame:
    """(pattern, valid_from, valid_to): when each pattern is listed, valid_to exclusive.

    Entries without a pattern, date or known action are void. Of several entries of a pattern at one time the removal
    wins. Entries that change nothing are passed over, so adjoining intervals are one.
    """
    clean = entries.where(F.col("pattern").isNotNull() & F.col("listed_at").isNotNull() & F.col("action").isin("add", "remove"))
    at = clean.groupBy("pattern", F.col("listed_at").cast("timestamp_ntz").alias("valid_from")).agg(F.min(F.col("action") == "add").alias("listed"))
    order = Window.partitionBy("pattern").orderBy("valid_from")
    changes = at.withColumn("before", F.coalesce(F.lag("listed").over(order), F.lit(False))).where(F.col("before") != F.col("listed"))
    ends = F.coalesce(F.lead("valid_from").over(order), F.lit(FOREVER).cast("timestamp_ntz"))
    return changes.withColumn("valid_to", ends).where("listed").select("pattern", "valid_from", "valid_to")


def filter_urls(captures: DataFrame, entries: DataFrame, url: str = "url", fetched_at: str = "fetched_at") -> DataFrame:
    """captures with host, blocked, matched_by (path, host or domain), matched_pattern and listed_since.

    A capture without a host or a fetch time is not blocked. Every capture keeps its row, repeated ones too;
    columns of captures that are named like one of the new ones give way. Distinct URLs and times are looked up, so
    that a hot one is a single row; what is found is joined back, broadcast once its number is counted and small, and
    else by shuffle, where Spark splits the partitions of hot URLs.
    """
    spans = bounded_broadcast(intervals(entries))
    named = captures.select(F.struct("*").alias("capture"), F.col(url).alias("u"), F.col(fetched_at).cast("timestamp_ntz").alias("at"))
    asked = named.where(F.col("u").isNotNull() & F.col("at").isNotNull()).select("u", "at").distinct()
    each = asked.select("u", "at", F.posexplode(lookups(F.col("u"))).alias("rank", "look")).select("u", "at", "rank", "look.by", F.col("look.pattern").alias("wanted"))
    active = (F.col("wanted") == F.col("pattern")) & (F.col("at") >= F.col("valid_from")) & (F.col("at") < F.col("valid_to"))
    hits = each.join(spans, active).groupBy(F.col("u").alias("of"), F.col("at").alias("then")).agg(F.min(F.struct("rank", "by", "pattern", F.col("valid_from").alias("since"))).alias("found"))
    out = named.join(bounded_broadcast(checkpoint(hits)), (F.col("u") == F.col("of")) & (F.col("at") == F.col("then")), "left")
    made = ("host", "blocked", "matched_by", "matched_pattern", "listed_since")
    kept = [F.col(f"capture.`{c}`").alias(c) for c in captures.columns if c.lower() not in made]
    return out.select(*kept, host_of(F.col("u")).alias("host"), F.col("found").isNotNull().alias("blocked"), F.col("found.by").alias("matched_by"), F.col("found.pattern").alias("matched_pattern"), F.col("found.since").alias("listed_since"))
