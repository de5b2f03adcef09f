"""Deliberate delay: tactics in outcome texts, features of a case, population baseline, z-scores and probability (DDD)."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketlens.functions.numbers import clamp, step_lookup
from docketlens.operators.advocates import GAPS_SQL, court_snapshot, gaps
from docketlens.operators.windows import ORDERED_SQL, ordered
from docketlens.plans.lineage import bounded_broadcast, checkpoint
from docketlens.plans.registry import query
from docketlens.sources.domain import PHRASES, PHRASES_SQL, TEXT_SQL, Tables, with_text

#: Patterns and weights by tactic, in the order that settles ties.
TACTICS = {
    "proxy_counsel": (
        (r"proxy\s+counsel", 3.0),
        (r"counsel.*out\s+of\s+station", 2.8),
        (r"counsel\s+not\s+present", 2.5),
        (r"counsel.*unavailable", 2.4),
        (r"appearing.*counsel.*absent", 2.6),
        (r"lead\s+counsel.*absent", 2.7),
        (r"counsel\s+is\s+out", 2.3),
        (r"counsel\s+not\s+ready", 2.0),
        (r"junior\s+counsel.*appearing", 1.8),
    ),
    "frivolous_filing": (
        (r"filing\s+of\s+(?:additional|fresh)\s+documents", 3.0),
        (r"(?:defect\s+in\s+filing|filing\s+defect)", 3.2),
        (r"(?:application|petition)\s+(?:defective|deficient)", 2.8),
        (r"papers?\s+(?:not|in)\s+complete", 2.6),
        (r"(?:pleading|petition)s?\s+(?:defective|improper)", 2.7),
        (r"filing\s+fee.*not\s+paid", 2.3),
        (r"(?:application|petition)\s+(?:not|not\s+properly)\s+signed", 2.2),
        (r"(?:amended|fresh)\s+petition\s+(?:filed|to be filed)", 2.0),
        (r"objections?\s+to\s+(?:petition|application)", 1.8),
    ),
    "judge_unavailable": (
        (r"(?:hon'?ble)?\s*judge\s+(?:is\s+)?on\s+leave", 3.0),
        (r"bench\s+did\s+not\s+assemble", 3.2),
        (r"bench\s+(?:could\s+not|did\s+not)\s+sit", 2.8),
        (r"judge\s+(?:unavailable|not\s+available)", 2.6),
        (r"judicial\s+officer.*unavailable", 2.6),
        (r"presiding\s+(?:officer|judge).*absent", 2.5),
        (r"court\s+not\s+(?:in\s+session|assembled)", 2.2),
        (r"judge.*on\s+transfer", 2.0),
        (r"judge\s+recused", 1.9),
        (r"establishment\s+of\s+bench", 1.5),
    ),
    "stay_extension": (
        (r"interim\s+order\s+(?:to\s+)?continue", 3.2),
        (r"stay\s+(?:order\s+)?(?:extended|to\s+continue)", 3.0),
        (r"existing\s+(?:interim\s+)?order\s+(?:continued|upheld)", 2.8),
        (r"interim\s+(?:relief|injunction)\s+(?:maintained|continued)", 2.8),
        (r"(?:status\s+)?quo\s+(?:maintained|continued)", 2.5),
        (r"further\s+(?:interim|staying)\s+(?:order|relief)", 2.5),
        (r"(?:interim\s+)?stay\s+(?:order|relief)\s+extended", 3.0),
        (r"interim\s+(?:application|relief).*allowed", 2.2),
        (r"extension\s+of\s+stay", 2.8),
    ),
}
#: Percentiles of a standard score, weights of the features, and the words that lead in a text.
Z_TABLE = ((-3, 0.1), (-2.5, 0.6), (-2, 2.3), (-1.5, 6.7), (-1, 15.9), (-0.5, 30.9), (0, 50), (0.5, 69.1), (1, 84.1), (1.5, 93.3), (2, 97.7), (2.5, 99.4), (3, 99.9))
WEIGHTS = {"density": 0.25, "party": 0.35, "cv": 0.20, "bench": 0.20}
LEAD_IN = r"^(after|thereafter|next|below|adjourned|adjourned[^:]*to)[^:]*:"


def prepared(text: Column) -> Column:
    t = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\s+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(t, LEAD_IN, ""), r"[^\w\s]", " "))


def tactic(text: Column) -> Column:
    """struct(tactic, confidence): the heaviest tactic of a text; weights times matches, scaled by a power.

    The prepared text and the scores are bound once, so that every pattern stands once in the expression.
    """
    bind = lambda value, body: F.element_at(F.transform(F.array(value), body), 1)

    def score(t: Column, patterns) -> Column:
        total = F.lit(0.0)
        for pattern, weight in patterns:
            total = total + weight * F.regexp_count(t, F.lit(pattern))
        return F.least(F.lit(1.0), F.pow(total / 4, F.lit(0.65)))

    def chosen(scores: Column) -> Column:
        best = F.array_max(scores)
        names = F.array(*[F.lit(name) for name in TACTICS])
        label = F.when(best < 0.15, "none").otherwise(F.element_at(names, F.array_position(scores, best).cast("int")))
        return F.struct(label.alias("tactic"), F.when(best < 0.15, 0.0).otherwise(best).alias("confidence"))

    return bind(bind(prepared(text), lambda t: F.array(*[score(t, patterns) for patterns in TACTICS.values()])), chosen)


def by_text(t: Tables, texts: DataFrame) -> DataFrame:
    """Adds the tactic to texts: each distinct text is classified once and joined back."""
    known = texts.select("text").distinct().withColumn("c", tactic(F.col("text")))
    return texts.join(known.withColumnRenamed("text", "of"), F.col("text").eqNullSafe(F.col("of"))).drop("of")


def _tactic_sql() -> str:
    total = {n: " + ".join(f"{w} * len(regexp_extract_all(t, '" + p.replace("'", "''") + "'))" for p, w in ps) for n, ps in TACTICS.items()}
    scores = ", ".join(f"least(1, pow(({e}) / 4, 0.65)) AS {n}" for n, e in total.items())
    names = list(TACTICS)
    return (
        TEXT_SQL
        + r", ut AS (SELECT DISTINCT text, trim(regexp_replace(regexp_replace(regexp_replace(lower(coalesce(text, '')), '\s+', ' ', 'g'), '^(after|thereafter|next|below|adjourned|adjourned[^:]*to)[^:]*:', ''), '[^\w\s]', ' ', 'g')) AS t FROM texts)"
        + f", us AS (SELECT text, {scores} FROM ut), ub AS (SELECT *, greatest({', '.join(names)}) AS best FROM us)"
        + ", uc AS (SELECT text, CASE WHEN best < 0.15 THEN 'none' "
        + " ".join(f"WHEN {n} = best THEN '{n}'" for n in names)
        + " END AS tactic, CASE WHEN best < 0.15 THEN 0 ELSE best END AS conf FROM ub), tac AS (SELECT texts.*, tactic, conf FROM texts JOIN uc USING (text))"
    )


TACTIC_SQL = _tactic_sql()


@query("ddd_1_tactics", TACTIC_SQL + " SELECT case_id, date, line, part, tactic, round(conf, 6) AS confidence FROM tac")
def tactics(t: Tables) -> DataFrame:
    return by_text(t, with_text(t.hearings)).select("case_id", "date", "line", "part", F.col("c.tactic").alias("tactic"), F.round("c.confidence", 6).alias("confidence"))


@query("ddd_2_density", "SELECT case_id, round(100 * count(*) FILTER (outcome_type = 'ADJOURNED') / count(*), 2) AS density, count(*) FILTER (date >= DATE '2001-12-31' - 180) AS recent FROM hearings GROUP BY 1")
def density(t: Tables) -> DataFrame:
    n, a = F.count(F.lit(1)), F.count_if(F.col("outcome_type") == "ADJOURNED")
    return t.hearings.groupBy("case_id").agg(F.round(100 * a / n, 2).alias("density"), F.count_if(F.col("date") >= F.date_sub(t.as_of, 180)).alias("recent"))


COUNTS_SQL = TACTIC_SQL + ", tc AS (SELECT case_id, count(*) AS n, " + ", ".join(f"count(*) FILTER (tactic = '{x}') AS {x}" for x in TACTICS) + " FROM tac WHERE outcome_type = 'ADJOURNED' GROUP BY 1)"


def tactic_counts(t: Tables) -> DataFrame:
    adjourned = with_text(t.hearings).where("outcome_type = 'ADJOURNED'")
    return by_text(t, adjourned).groupBy("case_id").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("c.tactic") == x).alias(x) for x in TACTICS])


@query("ddd_3_frequency", COUNTS_SQL + " SELECT * FROM tc")
def frequency(t: Tables) -> DataFrame:
    return tactic_counts(t)


PARTY_SQL = (
    COUNTS_SQL
    + """, ps AS (SELECT h.case_id, 100 * h.n_adjourned / h.n_hearings AS dens, coalesce(n, 0) AS n, coalesce(proxy_counsel, 0) AS pc, coalesce(frivolous_filing, 0) AS ff, coalesce(greatest(proxy_counsel, frivolous_filing, judge_unavailable, stay_extension), 0) AS mx,
      CAST(coalesce(proxy_counsel, 0) > 0 AS INT) + CAST(coalesce(frivolous_filing, 0) > 0 AS INT) + CAST(coalesce(judge_unavailable, 0) > 0 AS INT) + CAST(coalesce(stay_extension, 0) > 0 AS INT) AS div FROM last_hearings h LEFT JOIN tc USING (case_id)),
    party AS (SELECT case_id, dens, CASE WHEN n = 0 THEN 0 ELSE round(round(least(100, greatest(0, (pc / n * 40 + ff / n * 30 + div / 4 * 15 + least(dens / 100 * 15, 15)) * (1 + 0.5 * mx / n))), 9), 1) END AS party FROM ps)"""
)


def party_scores(t: Tables) -> DataFrame:
    """How far the parties drive the delay, from the shares of their tactics; 0 without adjournments."""
    joined = t.last_hearings.join(tactic_counts(t), "case_id", "left").fillna(0, ["n", *TACTICS])
    n, dens = F.col("n"), 100 * F.col("n_adjourned") / F.col("n_hearings")
    diversity = sum((F.col(x) > 0).cast("int") for x in list(TACTICS)[1:]) + (F.col("proxy_counsel") > 0).cast("int")
    share = lambda x: F.try_divide(F.col(x), n)
    raw = (share("proxy_counsel") * 40 + share("frivolous_filing") * 30 + diversity / 4 * 15 + F.least(dens / 100 * 15, F.lit(15.0))) * (1 + 0.5 * F.try_divide(F.greatest(*TACTICS), n))
    return joined.select("case_id", "n_hearings", dens.alias("density"), F.when(n == 0, 0.0).otherwise(F.round(F.round(clamp(raw, 0, 100), 9), 1)).alias("party"))


@query("ddd_4_party_score", PARTY_SQL + " SELECT case_id, CAST(party AS DOUBLE) AS party FROM party")
def party_score(t: Tables) -> DataFrame:
    return party_scores(t).select("case_id", "party")


VARIANCE_SQL = (
    GAPS_SQL
    + """, va AS (SELECT case_id, count(*) + 1 AS n, count(gap) FILTER (gap >= 1) AS k, avg(gap) FILTER (gap >= 1) AS mean, stddev_samp(gap) FILTER (gap >= 1) AS sd, max(gap) FILTER (gap >= 1) AS longest FROM gaps GROUP BY 1),
    cv AS (SELECT case_id, mean, sd, longest, sd / mean AS cv FROM va WHERE n - 1 >= 3 AND k >= 2)"""
)


def gap_variance(t: Tables) -> DataFrame:
    """Mean, deviation and coefficient of variation of the gaps of at least a day, for cases with three hearings and two gaps."""
    real = F.when(F.col("gap") >= 1, F.col("gap"))
    v = gaps(t.hearings).groupBy("case_id").agg(F.count(F.lit(1)).alias("n"), F.count(real).alias("k"), F.avg(real).alias("mean"), F.stddev_samp(real).alias("sd"), F.max(real).alias("longest"))
    return v.where("n >= 3 AND k >= 2").withColumn("cv", F.col("sd") / F.col("mean"))


@query("ddd_5_variance", VARIANCE_SQL + " SELECT case_id, round(mean, 1) AS mean, round(sd, 1) AS sd, longest, round(round(cv, 9), 3) AS cv, CASE WHEN round(cv, 9) < 0.3 THEN 'consistent' WHEN round(cv, 9) > 0.8 AND longest > 2.5 * mean THEN 'prolonged_gaps' ELSE 'irregular' END AS pattern FROM cv")
def variance(t: Tables) -> DataFrame:
    cv = F.round("cv", 9)
    pattern = F.when(cv < 0.3, "consistent").when((cv > 0.8) & (F.col("longest") > 2.5 * F.col("mean")), "prolonged_gaps").otherwise("irregular")
    return gap_variance(t).select("case_id", F.round("mean", 1).alias("mean"), F.round("sd", 1).alias("sd"), "longest", F.round(cv, 3).alias("cv"), pattern.alias("pattern"))


BENCH_SQL = (
    ORDERED_SQL
    + """, jj AS (SELECT case_id, judge_id, count(*) AS n, count(*) FILTER (outcome_type = 'ADJOURNED') AS a FROM hearings GROUP BY ALL), ju AS (SELECT case_id, count(*) AS judges, count(*) FILTER (n >= 3 AND a > 0.5 * n) AS high FROM jj GROUP BY 1),
    bc AS (SELECT case_id, count(*) AS n, count(*) FILTER (rn > 1 AND judge_id <> before) AS changes, date_diff('day', min(date), max(date)) / 365.25 AS years FROM o GROUP BY 1),
    bench AS (SELECT case_id, CASE WHEN bc.n < 2 THEN 0 ELSE round(round(0.4 * least(changes / coalesce(nullif(years, 0), 1) / 2, 1) + 0.35 * least(judges / n, 0.5) + 0.25 * high / judges, 9), 3) END AS bench FROM bc JOIN ju USING (case_id))"""
)


def bench_index(t: Tables) -> DataFrame:
    """How often judges change, how many there are, and how many of them adjourn most of three hearings or more; 0 for one hearing."""
    by_judge = t.hearings.where("judge_id IS NOT NULL").groupBy("case_id", "judge_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("outcome_type") == "ADJOURNED").alias("a"))
    judges = by_judge.groupBy("case_id").agg(F.count(F.lit(1)).alias("judges"), F.count_if((F.col("n") >= 3) & (F.col("a") > 0.5 * F.col("n"))).alias("high"))
    span = F.datediff(F.max("date"), F.min("date")) / 365.25
    changes = ordered(t.hearings.where("judge_id IS NOT NULL")).groupBy("case_id").agg(F.count(F.lit(1)).alias("n"), F.count_if((F.col("rn") > 1) & (F.col("judge_id") != F.col("before"))).alias("changes"), span.alias("years"))
    one = F.lit(1.0)
    raw = 0.4 * F.least(F.col("changes") / F.coalesce(F.nullif("years", F.lit(0.0)), one) / 2, one) + 0.35 * F.least(F.col("judges") / F.col("n"), F.lit(0.5)) + 0.25 * F.col("high") / F.col("judges")
    return changes.join(judges, "case_id").select("case_id", F.when(F.col("n") < 2, 0.0).otherwise(F.round(F.round(raw, 9), 3)).alias("bench"))


@query("ddd_6_bench_index", BENCH_SQL + " SELECT case_id, CAST(bench AS DOUBLE) AS bench FROM bench")
def bench(t: Tables) -> DataFrame:
    return bench_index(t)


def case_features(t: Tables) -> DataFrame:
    f = party_scores(t).join(gap_variance(t).select("case_id", F.round(F.round("cv", 9), 3).alias("cv")), "case_id", "left").join(bench_index(t), "case_id", "left")
    return f.fillna(0.0, ["cv", "bench"]).withColumn("density", F.round("density", 2))


FEAT_SQL = (
    PARTY_SQL
    + VARIANCE_SQL
    + BENCH_SQL
    + ", ft AS (SELECT p.case_id, h.n_hearings, round(dens, 2) AS density, CAST(party AS DOUBLE) AS party, coalesce(round(round(cv, 9), 3), 0) AS cv, coalesce(bench, 0) AS bench FROM party p JOIN last_hearings h USING (case_id) LEFT JOIN cv USING (case_id) LEFT JOIN bench USING (case_id))"
    + ", pop AS (SELECT case_id FROM cases JOIN last_hearings USING (case_id) ORDER BY filing_date DESC, case_id LIMIT 1000), bl AS (SELECT "
    + ", ".join(f"avg({k}) AS m_{k}, stddev_samp({k}) AS s_{k}" for k in WEIGHTS)
    + " FROM ft SEMI JOIN pop USING (case_id))"
    + ", zz AS (SELECT case_id, n_hearings, "
    + ", ".join(f"CASE WHEN coalesce(s_{k}, 0) = 0 THEN 0 ELSE ({k} - m_{k}) / s_{k} END AS z_{k}" for k in WEIGHTS)
    + " FROM ft, bl), zc AS (SELECT *, "
    + " + ".join(f"{w} * z_{k}" for k, w in WEIGHTS.items())
    + " AS z FROM zz)"
)


def population_baseline(t: Tables, size: int = 1000) -> DataFrame:
    """Mean and deviation of the features over the cases filed last: a top-k by filing, which Spark takes without a full sort.

    The hearings of these cases, at most size, are picked once by a broadcast and kept, before any feature is made of them.
    """
    heard = t.hearings.select("case_id").distinct()
    latest = t.cases.join(heard, "case_id", "left_semi").orderBy(F.desc_nulls_first("filing_date"), "case_id").limit(size).select("case_id")
    few = Tables(t.spark, t.sf_dir, t.as_of_text)
    few.hearings = checkpoint(t.hearings.join(F.broadcast(checkpoint(latest)), "case_id", "left_semi"))
    return case_features(few).agg(*[f(k).alias(f"{p}_{k}") for k in WEIGHTS for p, f in (("m", F.avg), ("s", F.stddev_samp))])


def z_scores(t: Tables) -> DataFrame:
    """Each feature against the population, and their weighted sum. The baseline is one row."""
    f = case_features(t)
    joined = f.join(population_baseline(t), F.lit(True))
    z = {k: F.when(F.coalesce(F.col(f"s_{k}"), F.lit(0.0)) == 0, 0.0).otherwise((F.col(k) - F.col(f"m_{k}")) / F.col(f"s_{k}")) for k in WEIGHTS}
    out = joined.select("case_id", "n_hearings", *[c.alias(f"z_{k}") for k, c in z.items()])
    total = sum((w * F.col(f"z_{k}") for k, w in list(WEIGHTS.items())[1:]), WEIGHTS["density"] * F.col("z_density"))
    return out.withColumn("z", total)


@query("agg_35_population", FEAT_SQL + " SELECT " + ", ".join(f"round(m_{k}, 6) AS m_{k}, round(s_{k}, 6) AS s_{k}" for k in WEIGHTS) + " FROM bl")
def population(t: Tables) -> DataFrame:
    b = population_baseline(t)
    return b.select(*[F.round(c, 6).alias(c) for c in b.columns])


@query("ddd_7_z_scores", FEAT_SQL + " SELECT case_id, " + ", ".join(f"round(z_{k}, 4) AS z_{k}" for k in WEIGHTS) + ", round(z, 4) AS z FROM zc")
def z_query(t: Tables) -> DataFrame:
    z = z_scores(t)
    return z.select("case_id", *[F.round(c, 4).alias(c) for c in (*[f"z_{k}" for k in WEIGHTS], "z")])


def _table_sql(x: str) -> str:
    parts = [f"WHEN {x} <= {Z_TABLE[0][0]} THEN {Z_TABLE[0][1]}"]
    parts += [f"WHEN {x} <= {x1} THEN {y0} + ({x} - {x0}) / ({x1} - {x0}) * ({y1} - {y0})" for (x0, y0), (x1, y1) in zip(Z_TABLE, Z_TABLE[1:], strict=False)]
    return "CASE " + " ".join(f"{p}" for p in parts) + f" ELSE {Z_TABLE[-1][1]} END"


PROB_SQL = FEAT_SQL + f", pr AS (SELECT *, {_table_sql('z')} AS p, least(1, greatest(0.3, n_hearings / 20)) AS confidence FROM zc)"


def probabilities(t: Tables) -> DataFrame:
    p = step_lookup(F.col("z"), Z_TABLE)
    return z_scores(t).withColumn("p", p).withColumn("confidence", clamp(F.col("n_hearings") / 20, 0.3, 1.0))


@query("ddd_8_percentile", PROB_SQL + " SELECT case_id, round(p, 3) AS percentile FROM pr")
def percentile(t: Tables) -> DataFrame:
    return probabilities(t).select("case_id", F.round("p", 3).alias("percentile"))


@query(
    "ddd_9_probability",
    PROB_SQL + " SELECT case_id, round(p, 3) AS probability, round(confidence, 4) AS confidence, CASE WHEN p < 30 THEN 'low' WHEN p < 60 THEN 'moderate' WHEN p < 85 THEN 'high' ELSE 'extreme' END AS risk, " + " + ".join(f"CAST(abs(z_{k}) > 2 AS INT)" for k in WEIGHTS) + " AS anomalies FROM pr",
)
def probability(t: Tables) -> DataFrame:
    p = F.col("p")
    risk = F.when(p < 30, "low").when(p < 60, "moderate").when(p < 85, "high").otherwise("extreme")
    odd = [(F.abs(f"z_{k}") > 2).cast("int") for k in WEIGHTS]
    return probabilities(t).select("case_id", F.round(p, 3).alias("probability"), F.round("confidence", 4).alias("confidence"), risk.alias("risk"), sum(odd[1:], odd[0]).alias("anomalies"))


@query(
    "srt_5_drivers",
    FEAT_SQL + ", dv AS (SELECT case_id, unnest([" + ", ".join(f"{{'name': '{k}', 'i': {i}, 'w': round(abs(z_{k}) * {w}, 9), 'z': abs(z_{k})}}" for i, (k, w) in enumerate(WEIGHTS.items())) + "]) AS s FROM zc), dt AS (SELECT case_id, s FROM dv QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY s.w DESC, s.i) <= 2) SELECT case_id, string_agg(s.name, ',' ORDER BY s.w DESC, s.i) AS drivers FROM dt WHERE s.z > 0.5 GROUP BY 1",
)
def drivers(t: Tables) -> DataFrame:
    """The two heaviest features of a case, of which those beyond half a deviation stay. Sorted inside the row."""
    parts = [F.struct((-F.round(F.abs(f"z_{k}") * w, 9)).alias("w"), F.lit(i).alias("i"), F.lit(k).alias("name"), F.abs(f"z_{k}").alias("z")) for i, (k, w) in enumerate(WEIGHTS.items())]
    top = F.filter(F.slice(F.array_sort(F.array(*parts)), 1, 2), lambda s: s["z"] > 0.5)
    return z_scores(t).select("case_id", F.array_join(F.transform(top, lambda s: s["name"]), ",").alias("drivers")).where("drivers <> ''")


@query("agg_34_batch_stats", PROB_SQL + ", rk AS (SELECT round(p, 6) AS p, row_number() OVER (ORDER BY p) - 1 AS i, count(*) OVER () AS n FROM pr) SELECT count(*) AS n, round(avg(p), 6) AS mean, min(p) AS low, max(p) AS high, max(p) FILTER (i = n // 2) AS upper_median, round(stddev_samp(p), 6) AS sd FROM rk")
def batch_stats(t: Tables) -> DataFrame:
    """Statistics of all cases; see batch_statistics."""
    return batch_statistics(probabilities(t), []).drop("suspects")


def batch_statistics(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Number, mean, least, most, upper median, deviation and suspects of the probabilities p of each batch; a batch is what shares the keys.

    Features are made once, for the counts of distinct rounded values, which are kept; all else follows from these counts.
    The upper of the two middle values comes from running counts inside the batch and a whole number, so that the largest
    batch is dealt to a hundred windows, and the counts of whole numbers come before them.
    """
    m, p = F.col("m"), F.col("p")
    values = rows.select(*keys, F.round("p", 6).alias("p"), (p >= 60).alias("suspect"))
    counts = checkpoint(values.groupBy(*keys, "p").agg(F.count(F.lit(1)).alias("m"), F.count_if("suspect").alias("suspects")))
    known = F.when(p.isNotNull(), m)
    sums = counts.groupBy(*keys).agg(F.coalesce(F.sum("m"), F.lit(0)).alias("n"), F.sum(known).alias("k"), F.sum(m * p).alias("total"), F.min("p").alias("low"), F.max("p").alias("high"), F.coalesce(F.sum("suspects"), F.lit(0)).alias("suspects"))
    sums = sums.withColumn("average", F.try_divide("total", "k"))
    same = lambda a, b: a.join(b, keys) if keys else a.join(b, F.lit(True))
    # Squares are taken around the mean, which is one row of each batch.
    squares = same(counts, F.broadcast(sums.select(*keys, "average"))).groupBy(*keys).agg(F.sum(m * (p - F.col("average")) * (p - F.col("average"))).alias("squares"))
    counts = counts.withColumn("whole", F.floor("p"))
    wholes = counts.groupBy(*keys, "whole").agg(F.sum("m").alias("of_whole"))
    batch = Window.partitionBy(*keys)
    sizes = wholes.select(*keys, "whole", (F.sum("of_whole").over(batch.orderBy("whole")) - F.col("of_whole")).alias("before"), F.sum("of_whole").over(batch).alias("size"))
    running = counts.join(sizes, [*keys, "whole"]).withColumn("upto", F.col("before") + F.sum("m").over(Window.partitionBy(*keys, "whole").orderBy("p")))
    middle = running.where("upto > floor(size / 2)").groupBy(*keys).agg(F.min("p").alias("upper_median"))
    deviation = F.when(F.col("k") > 1, F.sqrt(F.col("squares") / (F.col("k") - 1)))
    return same(same(sums, squares), middle).select(*keys, "n", F.round("average", 6).alias("mean"), "low", "high", F.round(deviation, 6).alias("sd"), "suspects", "upper_median")


@query(
    "ddd_10_batches",
    PROB_SQL
    + """, dk AS (SELECT court_id, is_disposed, round(p, 6) AS p, p >= 60 AS suspect FROM pr JOIN cases USING (case_id)),
    dr AS (SELECT *, row_number() OVER (PARTITION BY court_id, is_disposed ORDER BY p) - 1 AS i, count(*) OVER (PARTITION BY court_id, is_disposed) AS n FROM dk)
    SELECT court_id, is_disposed, count(*) AS n, round(avg(p), 6) AS mean, min(p) AS low, max(p) AS high, max(p) FILTER (i = n // 2) AS upper_median, round(stddev_samp(p), 6) AS sd, count(*) FILTER (suspect) AS suspects FROM dr GROUP BY ALL""",
)
def batches(t: Tables, keys: tuple[str, ...] = ("court_id", "is_disposed")) -> DataFrame:
    """The statistics of every batch of cases at once; the keys are a case's columns."""
    return batch_statistics(probabilities(t).select("case_id", "p").join(t.cases.select("case_id", *keys), "case_id"), list(keys))


CLASS_SQL = (
    """, rate AS (SELECT judge_id, count(*) FILTER (outcome_type = 'ADJOURNED') / count(*) AS r, count(DISTINCT case_id) AS total FROM hearings GROUP BY 1),
    s12 AS (SELECT case_id, date, line, part, requested_by, round(least(1, greatest(0, (CASE WHEN reason_type IN ('judge_unavailable', 'court_adjourned') THEN 0.1 WHEN reason_type IN ('file_not_ready', 'compliance_pending', 'interim_pending') THEN 0.3 WHEN reason_type IN ('counsel_unavailable', 'party_not_ready', 'other_procedural') THEN 0.5 WHEN reason_type = 'on_request' THEN 0.7 ELSE 0.65 END
      + CASE WHEN requested_by IS NOT NULL THEN 0.15 ELSE 0 END - CASE WHEN was_contested THEN 0.10 ELSE 0 END + CASE WHEN grounds = '' THEN 0.10 WHEN len(regexp_extract_all(grounds, '\\S+')) < 10 THEN 0.08 ELSE 0 END) * (CASE WHEN r > 0.6 THEN 1.15 WHEN r > 0.4 THEN 1.08 ELSE 1 END) * CASE WHEN total > 100 THEN 1.05 ELSE 1 END)), 9) AS score FROM (SELECT *, list_extract(""" + PHRASES_SQL + f""", CAST((case_id + line) % {len(PHRASES)} AS INTEGER) + 1) AS grounds FROM adjournments) JOIN rate USING (judge_id)),
    c12 AS (SELECT *, CASE WHEN score >= 0.75 THEN 'likely_tactic' WHEN score >= 0.60 THEN 'possible_tactic' WHEN score >= 0.40 THEN 'unclear' WHEN score >= 0.20 THEN 'likely_legitimate' ELSE 'legitimate' END AS class FROM s12)"""
)


@query("ddd_12_adjournment_class", CLASS_SQL + " SELECT case_id, date, line, part, CAST(round(score, 4) AS DOUBLE) AS score, class FROM c12")
def adjournment_class(t: Tables) -> DataFrame:
    return classified_adjournments(t).select("case_id", "date", "line", "part", F.round("raw_score", 4).alias("score"), "class")


def classified_adjournments(t: Tables) -> DataFrame:
    """A score from reason, request, contest and the grounds cited, scaled by the advocate's rate, which is one row per advocate.

    Each step is a column of its own, so that the next one names it and does not hold it several times over.
    """
    r = t.hearings.groupBy("judge_id").agg((F.count_if(F.col("outcome_type") == "ADJOURNED") / F.count(F.lit(1))).alias("r"), F.count_distinct("case_id").alias("total"))
    reason = F.col("reason_type")
    base = F.when(reason.isin("judge_unavailable", "court_adjourned"), 0.1).when(reason.isin("file_not_ready", "compliance_pending", "interim_pending"), 0.3).when(reason.isin("counsel_unavailable", "party_not_ready", "other_procedural"), 0.5).when(reason == "on_request", 0.7).otherwise(0.65)
    cited = F.when(F.col("grounds") == "", 0.10).when(F.regexp_count("grounds", F.lit(r"\S+")) < 10, 0.08).otherwise(0.0)
    raw = base + F.when(F.col("requested_by").isNotNull(), 0.15).otherwise(0.0) - F.when(F.col("was_contested"), 0.10).otherwise(0.0) + F.col("cited")
    scale = F.when(F.col("r") > 0.6, 1.15).when(F.col("r") > 0.4, 1.08).otherwise(1.0) * F.when(F.col("total") > 100, 1.05).otherwise(1.0)
    score = F.col("raw_score")
    label = F.when(score >= 0.75, "likely_tactic").when(score >= 0.60, "possible_tactic").when(score >= 0.40, "unclear").when(score >= 0.20, "likely_legitimate").otherwise("legitimate")
    rows = with_text(t.adjournments).join(bounded_broadcast(checkpoint(r)), "judge_id").withColumn("grounds", F.coalesce("text", F.lit(""))).withColumn("cited", cited).withColumn("scaled", raw * scale)
    return rows.withColumn("raw_score", F.round(clamp(F.col("scaled")), 9)).select("case_id", "date", "line", "part", "requested_by", "raw_score", label.alias("class"))


FRIVOLITY_SQL = (
    """, s13 AS (SELECT case_id, date, line, part, advocate_id, delay_days, round(least(1, greatest(0, CASE application_type WHEN 'stay_of_proceedings' THEN 0.45 WHEN 'bail' THEN 0.35 WHEN 'injunction' THEN 0.40 WHEN 'clarification' THEN 0.25 ELSE 0.35 END
      + CASE decision_status WHEN 'rejected' THEN 0.15 WHEN 'granted' THEN -0.20 WHEN 'dismissed' THEN 0.10 ELSE 0 END - CASE WHEN date_diff('day', date, decision_date) > 90 THEN 0.05 ELSE 0 END + 0.12 + CASE WHEN is_frivolous THEN 0.10 ELSE 0 END + CASE WHEN delay_days > 30 THEN 0.08 ELSE 0 END)), 9) AS score FROM applications),
    c13 AS (SELECT *, CASE WHEN score >= 0.80 THEN 'clearly' WHEN score >= 0.65 THEN 'likely' WHEN score >= 0.50 THEN 'possibly' WHEN score >= 0.35 THEN 'unclear' WHEN score >= 0.20 THEN 'unlikely' ELSE 'genuine' END AS class FROM s13)"""
)


@query("ddd_13_frivolity", FRIVOLITY_SQL + " SELECT case_id, date, line, part, CAST(round(score, 4) AS DOUBLE) AS score, class FROM c13")
def frivolity(t: Tables) -> DataFrame:
    return classified_applications(t).select("case_id", "date", "line", "part", F.round("raw_score", 4).alias("score"), "class")


def classified_applications(t: Tables) -> DataFrame:
    """Applications without grounds: type, decision, its time, a flag and the delay they caused."""
    kind = F.create_map(*[x for k, v in (("stay_of_proceedings", 0.45), ("bail", 0.35), ("injunction", 0.40), ("clarification", 0.25)) for x in (F.lit(k), F.lit(v))])
    status = F.create_map(F.lit("rejected"), F.lit(0.15), F.lit("granted"), F.lit(-0.20), F.lit("dismissed"), F.lit(0.10))
    raw = F.coalesce(kind[F.col("application_type")], F.lit(0.35)) + F.coalesce(status[F.col("decision_status")], F.lit(0.0)) - F.when(F.datediff("decision_date", "date") > 90, 0.05).otherwise(0.0) + 0.12
    raw = raw + F.when(F.col("is_frivolous"), 0.10).otherwise(0.0) + F.when(F.col("delay_days") > 30, 0.08).otherwise(0.0)
    score = F.col("raw_score")
    label = F.when(score >= 0.80, "clearly").when(score >= 0.65, "likely").when(score >= 0.50, "possibly").when(score >= 0.35, "unclear").when(score >= 0.20, "unlikely").otherwise("genuine")
    rows = t.applications.withColumn("raw", raw).withColumn("raw_score", F.round(clamp(F.col("raw")), 9))
    return rows.select("case_id", "date", "line", "part", "advocate_id", "delay_days", "raw_score", label.alias("class"))


SNAPSHOT_SQL = (
    GAPS_SQL
    + ORDERED_SQL
    + """, g1 AS (SELECT case_id, quantile_cont(gap, 0.5) AS med FROM gaps WHERE gap IS NOT NULL GROUP BY 1),
    r1 AS (SELECT court_id, n_adjourned / n_hearings AS rate, med FROM case_spans LEFT JOIN g1 USING (case_id) WHERE n_hearings > 0),
    snap AS (SELECT court_id, round(avg(rate), 6) AS mean_rate, round(coalesce(stddev_samp(rate), 0), 6) AS std_rate, median(med) AS median_gap FROM r1 GROUP BY 1),
    pa AS (SELECT case_id, count(*) AS adjourned, count(*) FILTER (reason_type IN ('on_request', 'party_not_ready', 'counsel_unavailable') OR requested_by IS NOT NULL) AS asked FROM adjournments GROUP BY 1),
    gs AS (SELECT case_id, avg(gap) AS mean_gap, coalesce(stddev_pop(gap) / nullif(avg(gap), 0), 0) AS cv FROM gaps WHERE gap >= 0 GROUP BY 1),
    ch AS (SELECT case_id, count(*) FILTER (rn > 1 AND judge_id IS DISTINCT FROM before) AS changes FROM o GROUP BY 1)"""
)


@query(
    "ddd_11_alternative",
    SNAPSHOT_SQL
    + """, f AS (SELECT c.case_id, CASE WHEN n_hearings > 0 THEN n_adjourned / n_hearings ELSE 0 END AS density, mean_rate, std_rate, median_gap, coalesce(100 * asked / adjourned, 0) AS party, coalesce(mean_gap, 0) AS mean_gap, coalesce(cv, 0) AS cv, coalesce(changes, 0) AS changes
      FROM case_spans c LEFT JOIN snap USING (court_id) LEFT JOIN pa USING (case_id) LEFT JOIN gs USING (case_id) LEFT JOIN ch USING (case_id))
    SELECT case_id, CAST(round(CASE WHEN coalesce(std_rate, 0) > 0 THEN (density - mean_rate) / std_rate ELSE 0 END, 4) AS DOUBLE) AS z, density > coalesce(mean_rate, 0) + 2 * coalesce(std_rate, 0) AS outlier,
      CASE WHEN party < 40 THEN 'low' WHEN party < 70 THEN 'moderate' WHEN party < 85 THEN 'high' ELSE 'extreme' END AS party_level,
      CASE WHEN mean_rate IS NULL THEN cv > 0.5 WHEN median_gap > 0 THEN mean_gap > 1.5 * median_gap ELSE cv > 0.8 END AS irregular,
      CAST(CASE WHEN changes > 3 THEN round(least(2 * changes / 10, 3), 1) ELSE 0 END AS DOUBLE) AS hunting, CASE WHEN changes > 3 AND least(2 * changes / 10, 3) >= 3 THEN 'moderate' WHEN changes > 3 AND least(2 * changes / 10, 3) >= 1.5 THEN 'minimal' ELSE 'none' END AS hunting_level FROM f""",
)
def alternative(t: Tables) -> DataFrame:
    """Features against the snapshot of a case's court: density, share asked for by parties, gaps and changes of judge."""
    asked = F.col("reason_type").isin("on_request", "party_not_ready", "counsel_unavailable") | F.col("requested_by").isNotNull()
    party = t.adjournments.groupBy("case_id").agg((100 * F.count_if(asked) / F.count(F.lit(1))).alias("party"))
    spread = gaps(t.hearings).where("gap >= 0").groupBy("case_id").agg(F.avg("gap").alias("mean_gap"), F.try_divide(F.stddev_pop("gap"), F.avg("gap")).alias("cv"))
    changes = ordered(t.hearings).groupBy("case_id").agg(F.count_if((F.col("rn") > 1) & ~F.col("judge_id").eqNullSafe(F.col("before"))).alias("changes"))
    f = t.case_spans.join(court_snapshot(t), "court_id", "left").join(party, "case_id", "left").join(spread, "case_id", "left").join(changes, "case_id", "left").fillna(0, ["party", "mean_gap", "cv", "changes"])
    density = F.coalesce(F.try_divide("n_adjourned", "n_hearings"), F.lit(0.0))
    mean, sd = F.coalesce("mean_rate", F.lit(0.0)), F.coalesce("std_rate", F.lit(0.0))
    hunting = F.when(F.col("changes") > 3, F.least(2 * F.col("changes") / 10, F.lit(3.0))).otherwise(0.0)
    p = F.col("party")
    return f.select(
        "case_id",
        F.round(F.when(sd > 0, (density - mean) / sd).otherwise(0.0), 4).alias("z"),
        (density > mean + 2 * sd).alias("outlier"),
        F.when(p < 40, "low").when(p < 70, "moderate").when(p < 85, "high").otherwise("extreme").alias("party_level"),
        F.when(F.col("mean_rate").isNull(), F.col("cv") > 0.5).when(F.col("median_gap") > 0, F.col("mean_gap") > 1.5 * F.col("median_gap")).otherwise(F.col("cv") > 0.8).alias("irregular"),
        F.round(hunting, 1).alias("hunting"),
        F.when(hunting >= 3, "moderate").when(hunting >= 1.5, "minimal").otherwise("none").alias("hunting_level"),
    )


@query(
    "ddd_14_attribution",
    CLASS_SQL
    + FRIVOLITY_SQL
    + """, direct AS (SELECT case_id, requested_by AS advocate_id, 'adjournment' AS kind, score AS confidence, 100 * score AS share, 15 AS days FROM c12 WHERE requested_by IS NOT NULL AND class IN ('likely_tactic', 'possible_tactic')
        UNION ALL SELECT case_id, advocate_id, 'application', score, 100 * score, coalesce(nullif(delay_days, 0), 20) FROM c13 WHERE class IN ('clearly', 'likely')),
      ind AS (SELECT case_id, advocate_id, count(*) AS n FROM (SELECT case_id, requested_by AS advocate_id FROM adjournments WHERE requested_by IS NOT NULL UNION ALL SELECT case_id, advocate_id FROM applications) GROUP BY ALL),
      pat AS (SELECT case_id, advocate_id, 'pattern' AS kind, least(0.6, 0.2 + 0.15 * n) AS confidence, 50 * least(0.6, 0.2 + 0.15 * n) AS share, 7 * n AS days FROM ind ANTI JOIN (SELECT DISTINCT case_id, advocate_id FROM direct WHERE confidence >= 0.5) USING (case_id, advocate_id) WHERE n >= 2)
      SELECT case_id, advocate_id, kind, count(*) AS n, CAST(round(max(CAST(confidence AS DOUBLE)), 4) AS DOUBLE) AS confidence, CAST(round(max(CAST(share AS DOUBLE)), 2) AS DOUBLE) AS share, CAST(sum(days) AS BIGINT) AS days FROM (SELECT * FROM direct UNION ALL SELECT * FROM pat) WHERE confidence >= 0.5 GROUP BY ALL""",
)
def attribution(t: Tables, least: float = 0.5) -> DataFrame:
    """Delay by advocate of each case: adjournments and applications that look like tactics; else a pattern of two or more of either.

    Every sign is scored once, and one grouping by case and advocate gives the rows of all three kinds.
    """
    asked = classified_adjournments(t).where("requested_by IS NOT NULL").select("case_id", F.col("requested_by").alias("advocate_id"), F.lit("adjournment").alias("kind"), F.col("raw_score").alias("confidence"), F.col("class").isin("likely_tactic", "possible_tactic").alias("suspect"), F.lit(15).cast("long").alias("days"))
    filed = classified_applications(t).select("case_id", "advocate_id", F.lit("application").alias("kind"), F.col("raw_score").alias("confidence"), F.col("class").isin("clearly", "likely").alias("suspect"), F.coalesce(F.nullif("delay_days", F.lit(0)), F.lit(20)).cast("long").alias("days"))
    signs = asked.unionByName(filed).withColumn("direct", F.when(F.col("suspect") & (F.col("confidence") >= least), F.col("kind")))
    kinds = ("adjournment", "application")
    of = lambda kind, column: F.when(F.col("direct") == kind, F.col(column))
    every = [f for k in kinds for f in (F.count(of(k, "direct")).alias(f"n_{k}"), F.max(of(k, "confidence")).alias(f"confidence_{k}"), F.sum(of(k, "days")).alias(f"days_{k}"))]
    pairs = signs.groupBy("case_id", "advocate_id").agg(F.count(F.lit(1)).alias("n"), *every).withColumn("sure", F.least(F.lit(0.6), 0.2 + 0.15 * F.col("n")))
    row = lambda kind, n, sure, share, days: F.struct(F.lit(kind).alias("kind"), n.cast("long").alias("n"), F.round(sure, 4).alias("confidence"), F.round(share, 2).alias("share"), days.cast("long").alias("days"))
    found = [F.when(F.col(f"n_{k}") > 0, row(k, F.col(f"n_{k}"), F.col(f"confidence_{k}"), 100 * F.col(f"confidence_{k}"), F.col(f"days_{k}"))) for k in kinds]
    # An advocate or a case that is not known is the same as no other, so that nothing direct stands against its pattern.
    alone = (F.col("n_adjournment") + F.col("n_application") == 0) | F.col("advocate_id").isNull() | F.col("case_id").isNull()
    found.append(F.when(alone & (F.col("n") >= 2) & (F.col("sure") >= least), row("pattern", F.lit(1), F.col("sure"), 50 * F.col("sure"), 7 * F.col("n"))))
    return pairs.select("case_id", "advocate_id", F.explode(F.array_compact(F.array(*found))).alias("of")).select("case_id", "advocate_id", "of.*")
