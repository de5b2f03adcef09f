"""Articles, names and privacy: syndication, attention, summaries, entity resolution, anonymisation (FED, ENT, MOD)."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketlens.plans.registry import query
from docketlens.plans.similarity import alike_sets
from docketlens.sources.domain import Tables

#: Word lists and patterns.
OPINIONS = (r"\b(allegedly|reportedly|claims?)\b", r"\b(should|must|ought|wrong|right)\b", r"\b(good|bad|excellent|terrible|great|awful)\b", r"\b(seems|appears to be|suggests)\b")
RISKY = ("bribe", "corrupt", "corruption", "fraud", "embezzle", "molestation", "money laundering", "kickback", "scam")
ACCUSING = (r"(?i)\b(is|was|are)\s+(guilty|corrupt|fraudulent)\b", r"(?i)\b(took|accepted)\s+(a\s+)?bribe\b", r"(?i)\bcommitted\s+(fraud|embezzlement|molestation)\b")
MASKS = ((r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[masked-email]"), (r"(?:\+91[-\s]?)?[6-9]\d{9}", "[masked-phone]"), (r"\b\d{12}\b", "[masked-id]"))
HONORIFICS = r"(?i)\b(hon'?ble|honourable|mr\.?|mrs\.?|ms\.?|dr\.?|justice|justices|jj\.?|j\.?|chief\s+justice)\b"
BENCHES = ("Hon'ble Mr. Justice A.B. Sharma, Justice C.D. Rao, J.", "Coram: JUSTICE C.D. Rao, J.", "Bench not constituted", "Division Bench: A.B. Sharma & C.D. Rao", "Mrs. E. Gupta / Dr. F. Iyer", "")


@query("fed_10_syndication", r", k AS (SELECT doc_id, source, md5(trim(regexp_replace(lower(text), '\s+', ' ', 'g'))) AS h FROM documents) SELECT h, count(*) AS n, count(DISTINCT source) AS sources, arg_min(source, doc_id) AS first_source FROM k GROUP BY 1 HAVING count(DISTINCT source) >= 2")
def syndication(t: Tables) -> DataFrame:
    """One text from several sources, by the hash of its folded form."""
    h = F.md5(F.trim(F.regexp_replace(F.lower("text"), r"\s+", " ")).cast("binary"))
    g = t.read("documents").select("doc_id", "source", h.alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("source").alias("sources"), F.min_by("source", "doc_id").alias("first_source"))
    return g.where("sources >= 2")


ATTENTION_SQL = """, g AS (SELECT user_id, avg(least(1, greatest(0, value / 100))) AS cred, date_diff('day', max(CAST(ts AS DATE)), DATE '2024-03-01') AS age, count(DISTINCT event_type) AS types, count(DISTINCT regexp_extract(props, '(-?\\d+)', 1)) AS sources, count(*) AS n FROM events GROUP BY 1),
    attended AS (SELECT user_id, round(0.35 * cred + 0.25 * CASE WHEN age <= 7 THEN 1 WHEN age <= 30 THEN 0.8 - (age - 7) / 23 * 0.3 WHEN age <= 90 THEN 0.5 - (age - 30) / 60 * 0.3 WHEN age <= 365 THEN 0.2 ELSE 0.05 END + 0.20 * greatest(types / 5, least(1, sources / 5))
    + 0.20 * CASE WHEN n <= 1 THEN 0.1 WHEN n <= 3 THEN 0.3 WHEN n <= 5 THEN 0.5 WHEN n <= 10 THEN 0.7 WHEN n <= 20 THEN 0.85 ELSE 1 END, 9) AS score FROM g)"""


@query("fed_11_attention", ATTENTION_SQL + " SELECT * FROM attended")
def attention(t: Tables, as_of: str = "2024-03-01") -> DataFrame:
    """Credibility, recency, diversity of kinds or sources, and volume of what is said of a subject. The steps are fixed values."""
    age, n = F.datediff(F.lit(as_of).cast("date"), F.max(F.to_date("ts"))), F.count(F.lit(1))
    cred = F.avg(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("value") / 100)))
    g = t.read("events").groupBy("user_id").agg(cred.alias("cred"), age.alias("age"), F.count_distinct("event_type").alias("types"), F.count_distinct(F.get_json_object("props", "$.k")).alias("sources"), n.alias("n"))
    a, m = F.col("age"), F.col("n")
    recency = F.when(a <= 7, 1.0).when(a <= 30, 0.8 - (a - 7) / 23 * 0.3).when(a <= 90, 0.5 - (a - 30) / 60 * 0.3).when(a <= 365, 0.2).otherwise(0.05)
    volume = F.when(m <= 1, 0.1).when(m <= 3, 0.3).when(m <= 5, 0.5).when(m <= 10, 0.7).when(m <= 20, 0.85).otherwise(1.0)
    diversity = F.greatest(F.col("types") / 5, F.least(F.lit(1.0), F.col("sources") / 5))
    return g.select("user_id", F.round(0.35 * F.col("cred") + 0.25 * recency + 0.20 * diversity + 0.20 * volume, 9).alias("score"))


@query("fed_13_html_clean", r"SELECT page_id, trim(regexp_replace(replace(replace(replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '\s+', ' ', 'g')) AS text FROM pages")
def html_clean(t: Tables) -> DataFrame:
    text = F.regexp_replace("html", r"<[^>]+>", " ")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return t.read("pages").select("page_id", F.trim(F.regexp_replace(text, r"\s+", " ")).alias("text"))


@query("fed_15_opinion", "SELECT doc_id, round(least(1, (" + " + ".join(f"len(regexp_extract_all(lower(text), '{p}'))" for p in OPINIONS) + r") / greatest(1, len(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ')) / 50)), 6) AS rate FROM documents")
def opinion(t: Tables) -> DataFrame:
    """Matches for every fifty words, at most 1."""
    lower = F.lower("text")
    hits = F.lit(0)
    for p in OPINIONS:
        hits = hits + F.regexp_count(lower, F.lit(p))
    words = F.size(F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " "))
    return t.read("documents").select("doc_id", F.round(F.least(F.lit(1.0), hits / F.greatest(F.lit(1.0), words / 50)), 6).alias("rate"))


def _mask(column: str) -> str:
    for pattern, mark in MASKS:
        column = f"regexp_replace({column}, '{pattern}', '{mark}', 'g')"
    return column


@query("mod_1_anonymise", f"SELECT doc_id, md5({_mask('text')}) AS masked_md5, {_mask('text')} <> text AS masked FROM documents")
def anonymise(t: Tables) -> DataFrame:
    masked = masked_text(F.col("text"))
    return t.read("documents").select("doc_id", F.md5(masked.cast("binary")).alias("masked_md5"), (masked != F.col("text")).alias("masked"))


def masked_text(text: Column) -> Column:
    """E-mail addresses, then phone numbers, then twelve-digit numbers, in this order."""
    for pattern, mark in MASKS:
        text = F.regexp_replace(text, pattern, mark)
    return text


@query("mod_2_risky", "SELECT doc_id, CAST(least(1, 0.2 * (" + " + ".join(f"CAST(contains(lower(text), '{k}') AS INT)" for k in RISKY) + ") + 0.4 * (" + " + ".join(f"CAST(regexp_matches(text, '{p}') AS INT)" for p in ACCUSING) + ")) AS DOUBLE) AS score FROM documents")
def risky(t: Tables) -> DataFrame:
    lower = F.lower("text")
    words = sum((lower.contains(k).cast("int") for k in RISKY[1:]), lower.contains(RISKY[0]).cast("int"))
    phrases = sum((F.col("text").rlike(p).cast("int") for p in ACCUSING[1:]), F.col("text").rlike(ACCUSING[0]).cast("int"))
    return t.read("documents").select("doc_id", F.round(F.least(F.lit(1.0), 0.2 * words + 0.4 * phrases), 6).alias("score"))


def folded(text: Column) -> Column:
    """NFKC and case folding, by the ICU library that Spark ships; null is empty."""
    composed = F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), F.coalesce(text, F.lit("")), F.lit(True))
    return F.java_method(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), composed, F.lit(True))


def normalised_name(name: Column) -> Column:
    """Folded, without the word coram, honorifics, punctuation and repeated spaces."""
    bare = F.regexp_replace(folded(name), r"(?i)^\s*coram\s*[:\-]\s*", "")
    plain = F.regexp_replace(F.regexp_replace(bare, HONORIFICS, " "), r"(?U)[^\w\s]", " ")
    return F.trim(F.regexp_replace(plain, r"\s+", " "))


def benches(t: Tables) -> DataFrame:
    texts = F.array(*[F.lit(b) for b in BENCHES])
    return t.read("orders").select(F.col("o_orderkey").alias("case_id"), F.get(texts, (F.col("o_orderkey") % len(BENCHES)).cast("int")).alias("bench"))


BENCH_SQL = "SELECT o_orderkey AS case_id, list_extract([" + ", ".join("'" + b.replace("'", "''") + "'" for b in BENCHES) + f"], CAST(o_orderkey % {len(BENCHES)} AS INTEGER) + 1) AS bench FROM orders"
NAME_SQL = r"trim(regexp_replace(regexp_replace(lower(regexp_replace(regexp_replace(part, '(?i)^\s*coram\s*[:\-]\s*', ''), '" + HONORIFICS.replace("'", "''") + r"', ' ', 'g')), '[^\w\s]', ' ', 'g'), '\s+', ' ', 'g'))"


def bench_parts(t: Tables) -> DataFrame:
    """(case_id, seq, name, role): a row for each judge of a bench, in order.

    The first one presides. The others preside too on a bench that calls itself single, are co-judges on a division bench
    and members on any other.
    """
    parts = F.filter(F.split("bench", r"(?i)\s*(?:,|&| and |/|\|)\s*"), lambda p: F.trim(p) != "")
    each = benches(t).where(~F.lower("bench").contains("bench not constituted")).select("case_id", F.lower("bench").alias("bench"), F.posexplode(parts).alias("seq", "part"))
    role = F.when((F.col("seq") == 0) | F.col("bench").contains("single bench"), "PRESIDING").when(F.col("bench").contains("division bench"), "CO_JUDGE").otherwise("JUDGE_MEMBER")
    return each.select("case_id", "seq", normalised_name(F.col("part")).alias("name"), role.alias("role")).where("name <> ''")


@query(
    "ent_4_parse_bench",
    f", b AS ({BENCH_SQL}), p AS (SELECT case_id, lower(bench) AS bench, generate_subscripts(string_split_regex(bench, '\\s*(?:,|&| and |/|\\|)\\s*'), 1) AS i, unnest(string_split_regex(bench, '\\s*(?:,|&| and |/|\\|)\\s*')) AS part FROM b WHERE NOT contains(lower(bench), 'bench not constituted')), n AS (SELECT case_id, bench, i, {NAME_SQL} AS name FROM p) SELECT case_id, CAST(i - 1 AS INTEGER) AS seq, name, CASE WHEN i = 1 OR contains(bench, 'single bench') THEN 'PRESIDING' WHEN contains(bench, 'division bench') THEN 'CO_JUDGE' ELSE 'JUDGE_MEMBER' END AS role FROM n WHERE name <> ''",
)
def parse_bench(t: Tables) -> DataFrame:
    return bench_parts(t)


def trigrams(name: Column) -> Column:
    padded = F.concat(F.lit("  "), F.lower(name), F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substr(padded, i, F.lit(3))))


@query(
    "join_12_trigrams",
    """, g AS (SELECT c_custkey AS k, list_distinct(list_transform(range(1, length(c_name) + 2), lambda i: substr('  ' || lower(c_name) || ' ', i, 3))) AS g FROM customer),
    w AS (SELECT s_suppkey AS s, list_distinct(list_transform(range(1, length(s_name) + 2), lambda i: substr('  ' || lower(s_name) || ' ', i, 3))) AS g FROM supplier),
    r AS (SELECT s, k, len(list_intersect(w.g, g.g)) AS hits, len(w.g) + len(g.g) AS total FROM w, g)
    SELECT s, k, round(hits / (total - hits), 6) AS sim FROM r WHERE hits / (total - hits) > 0.30 QUALIFY row_number() OVER (PARTITION BY s ORDER BY round(hits / (total - hits), 6) DESC, k) <= 30""",
)
def trigram_matches(t: Tables, least: float = 0.30, pool: int = 30) -> DataFrame:
    """The most alike names by shared trigrams, a pool of them for each name.

    Equal sets of trigrams meet once, and only where they share several rare trigrams at once (`alike_sets`), so that neither copies
    of a name nor trigrams which many names have make pairs.
    """
    a = t.read("supplier").select(F.col("s_suppkey").alias("id"), F.array_sort(trigrams(F.col("s_name"))).alias("grams"))
    b = t.read("customer").select(F.col("c_custkey").alias("id"), F.array_sort(trigrams(F.col("c_name"))).alias("grams"))
    return alike_sets(a, b, least, pool)


@query("fed_1_case_numbers", r", m AS (SELECT doc_id, unnest(regexp_extract_all(text, '(\d{1,4})/(\d{4})', 0)) AS number FROM documents) SELECT doc_id, number, count(*) AS n FROM m GROUP BY ALL")
def case_numbers(t: Tables) -> DataFrame:
    numbers = t.read("documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"(\d{1,4})/(\d{4})"), F.lit(0))).alias("number"))
    return numbers.groupBy("doc_id", "number").agg(F.count(F.lit(1)).alias("n"))


@query("src_6_article_hash", r"SELECT doc_id, sha256(lower(split_part(text, chr(10), 1) || '_' || source || '_' || lang)) AS content_hash FROM documents")
def article_hash(t: Tables) -> DataFrame:
    title = F.split("text", "\n")[0]
    return t.read("documents").select("doc_id", F.sha2(F.lower(F.concat_ws("_", title, "source", "lang")), 256).alias("content_hash"))
