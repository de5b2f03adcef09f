"""The queries of the training-data operators: each applies one of them to its whole table."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketlens.llm.bpe import encode_texts
from docketlens.llm.chat_format import format_chats
from docketlens.llm.conversation_repair import damaged, repaired
from docketlens.llm.filter_audit import audit
from docketlens.llm.fingerprints import fingerprint_edits
from docketlens.llm.html_extraction import extract_pages
from docketlens.llm.mixing import mix
from docketlens.llm.ngram_join import ngram_components
from docketlens.llm.quality_rules import judge
from docketlens.llm.secrets import BASE_KINDS, find_secrets, listed
from docketlens.llm.sharding import shard_rows
from docketlens.llm.toxicity import toxicity
from docketlens.llm.url_filters import filter_urls, patterns_of


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard_rows(documents(spark, sf_dir), shards=16)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def page_list(pages: DataFrame) -> DataFrame:
    """Dated list entries for the pages' hosts and sections, and two hosts that are listed throughout.

    There is no list among the tables, so the dates follow from the first page of a host or section by a rule that
    SQL has too: most hosts are listed, struck off and some of them listed again.
    """
    day = lambda n: F.date_add(F.lit("2024-01-01").cast("date"), n.cast("int")).cast("timestamp_ntz")
    entry = lambda df, n, action: df.select("pattern", day(n).alias("listed_at"), F.lit(action).alias("action"))
    first = lambda kind: pages.groupBy(patterns_of(F.col("url"))[kind].alias("pattern")).agg(F.min("page_id").alias("f"))
    f, hosts = F.col("f"), first("host").where("f % 3 <> 0")
    paths = first("path").where("f % 4 = 1")
    fixed = pages.sparkSession.createDataFrame([("spam-farm.example.org",), ("cheap-pills.example.com",)], "pattern string")
    parts = [entry(hosts, f * 13 % 200, "add"), entry(hosts, f * 13 % 200 + 40 + f % 90, "remove"), entry(hosts.where("f % 5 = 0"), f * 13 % 200 + 150, "add"), entry(paths, f * 7 % 300, "add"), entry(fixed, F.lit(0), "add")]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page is a capture; its fetch time, which the table lacks, is a day of 2024 by its number."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    fetched = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") * 7 % 366).cast("int")).cast("timestamp_ntz")
    found = filter_urls(pages.withColumn("fetched_at", fetched), page_list(pages))
    text = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    return found.select("page_id", "url", text("fetched_at"), "host", "blocked", "matched_by", "matched_pattern", text("listed_since"))


OP2_SQL = r"""
WITH p AS (
  SELECT page_id, url, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)) AS host,
         regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+/([^/?#]+)', 1) AS seg,
         DATE '2024-01-01' + CAST(page_id * 7 % 366 AS INTEGER) AS day FROM pages),
c AS (SELECT *, host || '/' || seg AS path, regexp_extract(host, '([^.]+\.[^.]+\.[^.]+)$', 1) AS domain FROM p),
h AS (SELECT host AS pattern, min(page_id) AS f FROM c GROUP BY 1 HAVING min(page_id) % 3 <> 0),
s AS (SELECT path AS pattern, min(page_id) AS f FROM c GROUP BY 1 HAVING min(page_id) % 4 = 1),
e AS (
  SELECT pattern, f * 13 % 200 AS d, true AS listed FROM h
  UNION ALL SELECT pattern, f * 13 % 200 + 40 + f % 90, false FROM h
  UNION ALL SELECT pattern, f * 13 % 200 + 150, true FROM h WHERE f % 5 = 0
  UNION ALL SELECT pattern, f * 7 % 300, true FROM s
  UNION ALL SELECT 'spam-farm.example.org', 0, true UNION ALL SELECT 'cheap-pills.example.com', 0, true),
u AS (SELECT pattern, DATE '2024-01-01' + CAST(d AS INTEGER) AS since, bool_and(listed) AS listed FROM e GROUP BY 1, 2),
g AS (SELECT *, coalesce(lag(listed) OVER (PARTITION BY pattern ORDER BY since), false) AS was FROM u),
k AS (SELECT *, coalesce(lead(since) OVER (PARTITION BY pattern ORDER BY since), DATE '9999-12-31') AS until FROM g WHERE was <> listed),
v AS (SELECT pattern, since, until FROM k WHERE listed)
SELECT c.page_id, c.url, strftime(c.day, '%Y-%m-%d') AS fetched_at, c.host,
       coalesce(a.pattern, b.pattern, d.pattern) IS NOT NULL AS blocked,
       CASE WHEN a.pattern IS NOT NULL THEN 'path' WHEN b.pattern IS NOT NULL THEN 'host' WHEN d.pattern IS NOT NULL THEN 'domain' END AS matched_by,
       coalesce(a.pattern, b.pattern, d.pattern) AS matched_pattern,
       strftime(CASE WHEN a.pattern IS NOT NULL THEN a.since WHEN b.pattern IS NOT NULL THEN b.since ELSE d.since END, '%Y-%m-%d') AS listed_since
FROM c
LEFT JOIN v a ON a.pattern = c.path AND c.day >= a.since AND c.day < a.until
LEFT JOIN v b ON b.pattern = c.host AND c.day >= b.since AND c.day < b.until
LEFT JOIN v d ON d.pattern = c.domain AND c.day >= d.since AND c.day < d.until
"""


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The SQL has all of it but the folding of near copies, whose sketches DuckDB has no hash for; see the tests."""
    return judge(documents(spark, sf_dir))


OP4_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, text FROM d),
m AS (SELECT doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols FROM w),
l AS (SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS line FROM d),
lw AS (SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n,
              regexp_replace(trim(regexp_replace(lower(line), '[\x20\x09-\x0D]+', ' ', 'g')), '[0-9]', '0', 'g') AS norm
       FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM lw GROUP BY 1),
most AS (SELECT source, greatest(20, 0.04 * count(DISTINCT text)) AS most FROM d GROUP BY 1),
freq AS (SELECT source, norm FROM lw JOIN most USING (source) GROUP BY source, norm, most HAVING count(DISTINCT text) > most),
rem AS (SELECT doc_id, sum(n) AS removed_words FROM lw JOIN freq USING (source, norm) GROUP BY 1),
win AS (SELECT doc_id, i, words[i:i+7] AS win FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM w)),
hit AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, win) > 1),
cov AS (SELECT doc_id, count(DISTINCT i + j) AS n_repeat_words FROM hit, range(8) t(j) GROUP BY 1),
f AS (SELECT m.doc_id, n_words, word_chars, n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
             CAST(coalesce(removed_words, 0) AS BIGINT) AS removed_words
      FROM m LEFT JOIN dup USING (doc_id) LEFT JOIN cov USING (doc_id) LEFT JOIN rem USING (doc_id))
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND n_words - removed_words >= 0.3 * n_words AS kept
FROM f
"""


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(documents(spark, sf_dir), words=5, percent=75)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(documents(spark, sf_dir))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return pages.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fingerprint_edits(documents(spark, sf_dir))
    return found.select("doc_id", "n_chars", F.sha2("edited_text", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tokenizer file comes from the installed public_tokenizers package, which every executor has."""
    import public_tokenizers

    coded = encode_texts(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), decode=True)
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(documents(spark, sf_dir))
    number = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = [number(kind) for kind in BASE_KINDS]
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    return found.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


OP11_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS part FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words, coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS again FROM d),
b AS (SELECT doc_id, part, len(words) < 100 AS a, 100 * len(list_distinct(words)) < 80 * len(words) AS b, 100 * len(regexp_extract_all(t, '[A-Z]')) > 10 * length(t) AS c,
             regexp_matches(t, '[#$%&*|]') AS d, again AS e FROM w),
l AS (SELECT doc_id, max(CAST(quality = 1 AS BIGINT)) AS good, max(CAST(toxic = 1 AS BIGINT)) AS toxic FROM labels GROUP BY 1),
k AS (SELECT part, [a, b, c, d, e] AS fails, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM b LEFT JOIN l USING (doc_id) GROUP BY ALL),
f(i) AS (VALUES (1), (2), (3), (4), (5)),
o AS (SELECT [p.i, q.i, r.i, s.i, t.i] AS places FROM f p, f q, f r, f s, f t WHERE len(list_distinct([p.i, q.i, r.i, s.i, t.i])) = 5),
x AS (SELECT part, array_to_string(list_transform(places, lambda i: substr('ABCDE', i, 1)), '') AS filter_order, f.i AS step, places[f.i] AS own, n, good, toxic, fails[places[f.i]] AS hit,
             len(list_filter(places[1:f.i - 1], lambda i: fails[i])) > 0 AS gone, len(list_filter(fails, lambda z: z)) = 1 AS alone FROM k, o, f),
g AS (SELECT part, filter_order, step, own,
             CAST(coalesce(sum(n) FILTER (NOT gone AND NOT hit), 0) AS BIGINT) AS kept, CAST(coalesce(sum(n) FILTER (NOT gone AND hit), 0) AS BIGINT) AS removed,
             CAST(coalesce(sum(n) FILTER (gone AND hit), 0) AS BIGINT) AS redundant, CAST(coalesce(sum(n) FILTER (hit AND alone), 0) AS BIGINT) AS unique_fails,
             CAST(coalesce(sum(good) FILTER (NOT gone AND hit), 0) AS BIGINT) AS good_lost, CAST(coalesce(sum(toxic) FILTER (NOT gone AND hit), 0) AS BIGINT) AS toxic_lost FROM x GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM g
"""


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored.select("doc_id", "held_out", "score", "predicted")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return repaired(conversations, damaged(conversations))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_sharding": op1_sharding,
        "op2_url_filters": op2_url_filters,
        "op4_quality_rules": op4_quality_rules,
        "op5_chat_format": op5_chat_format,
        "op6_ngram_join": op6_ngram_join,
        "op7_mixing": op7_mixing,
        "op8_fingerprints": op8_fingerprints,
        "op3_html_extraction": op3_html_extraction,
        "op9_bpe": op9_bpe,
        "op10_secrets": op10_secrets,
        "op11_filter_audit": op11_filter_audit,
        "op12_toxicity": op12_toxicity,
        "op13_conversation_repair": op13_conversation_repair,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_url_filters": OP2_SQL, "op4_quality_rules": OP4_SQL, "op11_filter_audit": OP11_SQL}
