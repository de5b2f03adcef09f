"""Importance of a case: components, weighted sum through a logistic curve, and confidence (IMP)."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketlens.functions.numbers import clamp
from docketlens.plans.registry import query
from docketlens.sources.domain import Tables

#: Weights of the components, values of case types, corruption keywords.
WEIGHTS = {"politician": 0.30, "corruption": 0.20, "kind": 0.15, "media": 0.15, "monetary": 0.10, "urgency": 0.07, "historical": 0.03}
TYPES = {"automobile": 1.0, "building": 0.9, "furniture": 0.7, "household": 0.2, "machinery": 0.4}
KEYWORDS = ("bribery", "graft", "kickback", "embezzlement", "money laundering", "disproportionate assets", "quid pro quo", "scam", "corruption", "tender rigging", "abuse of office", "benami")
CAP = 5e7
#: Subjects of cases, which the tables lack, in the order of their numbers.
SUBJECTS = ("Dispute over a wall between two plots", "Bribery and kickback in a tender rigging scam", "Sale of goods, price not paid", "Disproportionate assets of an officer, money laundering alleged, investigation pending for years", "", "Appeal against a tax order in which the department says that no corruption of the record took place and that the assessment was made upon the accounts of the firm as they stood at the end of the year")

LINKS_SQL = ", links AS (SELECT case_id, judge_id AS official_id, confidence, tax >= 0.07 AS verified FROM hearings WHERE line = 1), pol AS (SELECT case_id, CASE WHEN bool_or(verified) THEN 1 ELSE least(1, 0.6 + 0.4 * max(confidence)) END AS politician FROM links GROUP BY 1)"


def politician(t: Tables) -> DataFrame:
    """Cases linked with an official: 1 if a link is verified, else by the best match."""
    links = t.hearings.where("line = 1")
    return links.groupBy("case_id").agg(F.when(F.bool_or(F.col("tax") >= 0.07), 1.0).otherwise(clamp(0.6 + 0.4 * F.max("confidence"))).alias("politician"))


@query("imp_2_politician", LINKS_SQL + " SELECT case_id, round(politician, 6) AS politician FROM pol")
def politician_query(t: Tables) -> DataFrame:
    return politician(t).select("case_id", F.round("politician", 6).alias("politician"))


def keyword_density(text: Column, keywords=KEYWORDS) -> Column:
    """Non-overlapping hits of the keywords per word, times 250, at most 1."""
    lower = F.lower(F.coalesce(text, F.lit("")))
    hits = F.lit(0)
    for k in keywords:
        hits = hits + F.floor((F.length(lower) - F.length(F.replace(lower, F.lit(k), F.lit("")))) / len(k))
    words = F.greatest(F.lit(1), F.size(F.split(F.trim(F.regexp_replace(lower, r"\s+", " ")), " ")))
    return clamp(hits / words * 250)


@query(
    "imp_3_corruption",
    "SELECT doc_id, round(least(1, (" + " + ".join(f"(length(x) - length(replace(x, '{k}', ''))) // {len(k)}" for k in KEYWORDS) + r") / greatest(1, len(string_split(trim(regexp_replace(x, '\s+', ' ', 'g')), ' '))) * 250), 6) AS density FROM (SELECT doc_id, lower(coalesce(text, '')) AS x FROM documents)",
)
def corruption(t: Tables) -> DataFrame:
    return t.read("documents").select("doc_id", F.round(keyword_density(F.col("text")), 6).alias("density"))


@query(
    "imp_4_media",
    """, m AS (SELECT user_id, least(1, greatest(0, value / 100)) AS cred, date_diff('day', CAST(ts AS DATE), DATE '2024-02-01') AS age FROM events),
    g AS (SELECT user_id, sum(cred * exp(-0.05 * age)) AS w, count(*) FILTER (cred < 0.3 AND age <= 2) AS low FROM m GROUP BY 1)
    SELECT user_id, round(least(1, ln(1 + CASE WHEN low >= 6 THEN least(w, 1.5) ELSE w END) / ln(6)), 6) AS media FROM g""",
)
def media(t: Tables, as_of: str = "2024-02-01") -> DataFrame:
    """Mentions by credibility, fading with age; a burst of poor ones is capped."""
    return mentions(t, as_of).select("user_id", F.round("media", 6).alias("media"))


COMPONENTS_SQL = (
    LINKS_SQL
    + """, mm AS (SELECT user_id, least(1, greatest(0, value / 100)) AS cred, date_diff('day', CAST(ts AS DATE), DATE '2024-02-01') AS age FROM events),
    mg AS (SELECT user_id, count(*) AS mentions, sum(cred * exp(-0.05 * age)) AS w, count(*) FILTER (cred < 0.3 AND age <= 2) >= 6 AS capped FROM mm GROUP BY 1),
    med AS (SELECT user_id, mentions, capped, least(1, ln(1 + CASE WHEN capped THEN least(w, 1.5) ELSE w END) / ln(6)) AS media FROM mg),
    su AS (SELECT *, lower(list_extract([""" + ", ".join(f"'{x}'" for x in SUBJECTS) + f"""], CAST(case_id % {len(SUBJECTS)} AS INTEGER) + 1)) AS x FROM case_spans),
    comp AS (SELECT case_id, coalesce(politician, 0) AS politician, least(1, ({" + ".join(f"(length(x) - length(replace(x, '{k}', ''))) // {len(k)}" for k in KEYWORDS)}) / greatest(1, len(string_split(x, ' '))) * 250) AS corruption,
    CASE case_type {" ".join(f"WHEN '{k}' THEN {v}" for k, v in TYPES.items())} ELSE 0.3 END AS kind, coalesce(media, 0) AS media, coalesce(mentions, 0) AS mentions, coalesce(capped, false) AS capped, amount IS NOT NULL AS valued,
    ln(1 + least(amount, 5e7)) / ln(1 + 5e7) AS monetary, CASE WHEN priority = '1-URGENT' THEN 1 ELSE 0 END AS urgency, least(1, ln(1 + n_hearings) / ln(1 + 1e4)) AS historical, n_hearings, filing_date FROM su LEFT JOIN pol USING (case_id) LEFT JOIN med ON case_id % 1000 = user_id),
    imp AS (SELECT *, 1 / (1 + exp(-6 * ({" + ".join(f"{w} * {k}" for k, w in WEIGHTS.items())} - 0.5))) AS score, CAST(politician > 0 AS INT) + CAST(corruption > 0 AS INT) + CAST(mentions > 0 AS INT) + CAST(valued AS INT) AS signals FROM comp)"""
)


def mentions(t: Tables, as_of: str = "2024-02-01") -> DataFrame:
    """What the media say of each subject: the score, the number of mentions and whether a burst of poor ones was capped."""
    cred = clamp(F.col("value") / 100)
    age = F.coalesce(F.datediff(F.lit(as_of).cast("date"), F.to_date("ts")), F.lit(90))
    g = t.read("events").select("user_id", cred.alias("cred"), age.alias("age")).groupBy("user_id").agg(F.count(F.lit(1)).alias("mentions"), F.sum(F.col("cred") * F.exp(-0.05 * F.col("age"))).alias("w"), F.count_if((F.col("cred") < 0.3) & (F.col("age") <= 2)).alias("low"))
    capped = F.col("low") >= 6
    w = F.when(capped, F.least("w", F.lit(1.5))).otherwise(F.col("w"))
    return g.select("user_id", "mentions", capped.alias("capped"), clamp(F.log1p(w) / F.log1p(F.lit(5.0))).alias("media"))


def components(t: Tables) -> DataFrame:
    """All components of each case. A case's subject and the user that media mentions are about go by its number."""
    kind = F.coalesce(F.create_map(*[x for k, v in TYPES.items() for x in (F.lit(k), F.lit(v))])[F.col("case_type")], F.lit(0.3))
    monetary = F.log1p(F.least("amount", F.lit(CAP))) / F.log1p(F.lit(CAP))
    urgency = F.when(F.col("priority") == "1-URGENT", 1.0).otherwise(0.0)
    subject = F.get(F.array(*[F.lit(s) for s in SUBJECTS]), (F.col("case_id") % len(SUBJECTS)).cast("int"))
    joined = t.case_spans.join(politician(t), "case_id", "left").join(mentions(t), F.col("case_id") % 1000 == F.col("user_id"), "left")
    return joined.select("case_id", F.coalesce("politician", F.lit(0.0)).alias("politician"), keyword_density(subject).alias("corruption"), kind.alias("kind"), F.coalesce("media", F.lit(0.0)).alias("media"), F.coalesce("mentions", F.lit(0)).alias("mentions"), F.coalesce("capped", F.lit(False)).alias("capped"), F.col("amount").isNotNull().alias("valued"), monetary.alias("monetary"), urgency.alias("urgency"), clamp(F.log1p("n_hearings") / F.log1p(F.lit(1e4))).alias("historical"), "n_hearings", "filing_date")


def importance_score(override: Column | None = None) -> Column:
    """A logistic curve over the weighted sum; a manual score wins."""
    raw = sum((w * F.col(k) for k, w in list(WEIGHTS.items())[1:]), WEIGHTS["politician"] * F.col("politician"))
    score = 1 / (1 + F.exp(-6 * (raw - 0.5)))
    return score if override is None else F.coalesce(override, score)


@query("imp_1_score", COMPONENTS_SQL + " SELECT case_id, round(score, 6) AS score FROM imp")
def score(t: Tables) -> DataFrame:
    return components(t).select("case_id", F.round(importance_score(), 6).alias("score"))


@query("imp_5_monetary", COMPONENTS_SQL + " SELECT case_id, round(monetary, 6) AS monetary, round(historical, 6) AS historical FROM comp")
def monetary(t: Tables) -> DataFrame:
    return components(t).select("case_id", F.round("monetary", 6).alias("monetary"), F.round("historical", 6).alias("historical"))


@query("imp_6_type_priority", COMPONENTS_SQL + " SELECT case_id, CAST(kind AS DOUBLE) AS kind, CAST(urgency AS DOUBLE) AS urgency FROM comp")
def type_priority(t: Tables) -> DataFrame:
    return components(t).select("case_id", "kind", "urgency")


@query("imp_7_confidence", COMPONENTS_SQL + " SELECT case_id, round(least(1, greatest(0.2, (0.75 * signals / 4 + 0.25 * exp(-date_diff('day', filing_date, DATE '2001-12-31') / 180)) * CASE WHEN capped THEN 0.85 ELSE 1 END * CASE WHEN signals < 2 THEN 0.5 ELSE 1 END)), 6) AS confidence FROM imp")
def confidence(t: Tables) -> DataFrame:
    return components(t).select("case_id", F.round(case_confidence(t.as_of), 6).alias("confidence"))


def case_confidence(as_of: Column) -> Column:
    """From the share of four independent signals and from freshness; less where mentions were capped or signals are few."""
    signals = (F.col("politician") > 0).cast("int") + (F.col("corruption") > 0).cast("int") + (F.col("mentions") > 0).cast("int") + F.col("valued").cast("int")
    recency = F.coalesce(F.exp(-F.datediff(as_of, "filing_date") / 180), F.lit(0.5))
    c = (0.75 * signals / 4 + 0.25 * recency) * F.when(F.col("capped"), 0.85).otherwise(1.0) * F.when(signals < 2, 0.5).otherwise(1.0)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.2), c))


@query(
    "srt_6_top_components",
    COMPONENTS_SQL + ", x AS (SELECT case_id, unnest([" + ", ".join(f"{{'n': '{k}', 'i': {i}, 'w': round({w} * {k}, 9)}}" for i, (k, w) in enumerate(WEIGHTS.items())) + "]) AS s FROM comp) SELECT case_id, string_agg(s.n, ',' ORDER BY s.w DESC, s.i) AS top FROM (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY s.w DESC, s.i) <= 3) GROUP BY 1",
)
def top_components(t: Tables) -> DataFrame:
    parts = F.array(*[F.struct((-F.round(w * F.col(k), 9)).alias("w"), F.lit(i).alias("i"), F.lit(k).alias("n")) for i, (k, w) in enumerate(WEIGHTS.items())])
    return components(t).select("case_id", F.array_join(F.transform(F.slice(F.array_sort(parts), 1, 3), lambda s: s["n"]), ",").alias("top"))
