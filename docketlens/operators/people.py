"""Names of judges, parties and officials: keys, variants, candidates and their scores, assignments and merges (ENT)."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketlens.operators.feeds import BENCH_SQL, NAME_SQL, bench_parts, benches, normalised_name
from docketlens.plans.lineage import checkpoint, ship
from docketlens.plans.registry import query
from docketlens.plans.similarity import alike, alike_to, alike_word_sets, common_subsequence, nearest, ratio, ratio_of, token_set_ratio
from docketlens.sources.domain import Tables

__all__ = ["common_subsequence", "ratio", "token_set_ratio"]

#: Weights of a candidate's score, the least score of a match, and the digits of letters in the phonetic key.
WEIGHTS = {"exact": 0.30, "overlap": 0.20, "ratio": 0.20, "phonetic": 0.10, "court": 0.10, "tenure": 0.05, "designation": 0.05}
LEAST = 0.60
#: The trigram likeness that candidates exceed and how many of them are scored; a ratio below LOW counts for less; the least confidence of an assignment to a new entry.
TRIGRAM, POOL, LOW, FLOOR = 0.30, 30, 1 - 0.18 - 0.5, 0.35
#: Fixed value: share of a cosine that counts as confidence. Days after which an unseen provisional entry is stale.
NEIGHBOUR, STALE = 0.75, 365
LETTERS, DIGITS = "bfpvcgjkqsxzdtlmnr", "111122222222334556"
#: Names of the registry, of parties and of officials, which the tables lack, in the order of their numbers.
REGISTRY = ("A.B. Sharma", "C.D. Rao", "E. Gupta", "F. Ayer", "A.B. Sharmaa", "G. Menon")
PARTIES = ("Sharma A B", "State through C.D. Rao", "Messrs. Gupta Traders", "F Iyer", "Union of India", "Ravi Kumar", "Kumar, Ravi and others", "")
OFFICIALS = ("A B Sharma", "Ravi Kumar", "Gupta Trader", "E. Menon")
TOKEN_SET = 85
MERGE, MERGE_CAP, SUGGESTIONS = 0.85, 0.99, 100


def soundex_code(token: Column) -> Column:
    """First letter and three digits. Letters without a digit, h and w among them, let the next one count again; the first letter's digit hides nothing."""
    rest = F.regexp_replace(F.substr(token, F.lit(2)), f"[^{LETTERS}]", "0")
    digits = F.translate(rest, LETTERS, DIGITS)
    for d in "123456":
        digits = F.regexp_replace(digits, d + "+", d)
    return F.when(token == "", "").otherwise(F.left(F.concat(F.upper(F.left(token, F.lit(1))), F.replace(digits, F.lit("0"), F.lit("")), F.lit("000")), F.lit(4)))


def phonetic_key(normalised: Column) -> Column:
    """Codes of a normalised name's words, joined by hyphens; initials that follow each other are one word."""
    merged = F.regexp_replace(normalised, r"(?<!\S)(\w) (?=\w(?!\S))", "$1")
    return F.array_join(F.transform(F.filter(F.split(merged, " "), lambda x: x != ""), soundex_code), "-")


def variants(normalised: Column) -> Column:
    """A name, its initials with the last word, its words reversed, and its words without initials; each once, sorted."""
    words = F.filter(F.split(normalised, " "), lambda x: x != "")
    many = F.size(words) > 1
    initials = F.concat(F.transform(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), lambda x: F.concat(F.left(x, F.lit(1)), F.lit("."))), F.slice(words, -1, 1))
    found = F.array(normalised, F.when(many, F.array_join(initials, " ")), F.when(many, F.array_join(F.reverse(words), " ")), F.array_join(F.filter(words, lambda x: F.length(x) > 1), " "))
    return F.array_sort(F.array_distinct(F.filter(F.array_compact(found), lambda x: x != "")))


def named(t: Tables, names, key: str, table: str, column: str) -> DataFrame:
    texts = F.array(*[F.lit(n) for n in names])
    return t.read(table).select(F.col(column).alias(key), F.get(texts, (F.col(column) % len(names)).cast("int")).alias("name"))


def registry(t: Tables) -> DataFrame:
    """(known, court, judge_id, sound): the first entry of each name of a court; some entries belong to no court."""
    texts = F.array(*[F.lit(n) for n in REGISTRY])
    court = F.when(F.col("s_suppkey") % 7 != 3, F.col("s_nationkey"))
    rows = t.read("supplier").select("s_suppkey", court.alias("court"), normalised_name(F.get(texts, (F.col("s_suppkey") % len(REGISTRY)).cast("int"))).alias("known"))
    return rows.groupBy("known", "court").agg(F.min("s_suppkey").alias("judge_id")).withColumn("sound", phonetic_key(F.col("known")))


def bench_tokens(t: Tables) -> DataFrame:
    """(case_id, seq, name, role, court_id): the judges that benches name, with the court of the case."""
    return bench_parts(t).join(t.cases.select("case_id", "court_id"), "case_id")


def word_trigrams(name: Column) -> Column:
    """Distinct trigrams of each word with two spaces before and one after it."""
    padded = F.transform(F.filter(F.split(name, " "), lambda w: w != ""), lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    return F.array_distinct(F.flatten(F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.char_length(w) - 2), lambda i: F.substr(w, i, F.lit(3))))))


def pool(names: DataFrame, known: DataFrame, least: float = TRIGRAM, most: int = POOL) -> DataFrame:
    """(name, court_id, known, court, judge_id, sound): the registry entries that a name may stand for.

    Entries of another court are shut out: a name meets those of its court and those of no court, a name without a court
    all of them. Trigrams are ordered from rare to frequent, and two names as alike as needed share one of the first
    n - ceil(least * n) + 1, so that a word which all names have makes no pairs.
    """
    names, known = names.select("name", "court_id").where("name <> ''"), known.where("known <> ''")
    texts = names.select(F.col("name").alias("text")).unionByName(known.select(F.col("known").alias("text"))).distinct()
    each = texts.select("text", F.explode(word_trigrams(F.col("text"))).alias("gram"))
    often = each.groupBy(F.col("gram").alias("of")).agg(F.count(F.lit(1)).alias("df"))
    ordered = each.join(often, F.col("gram") == F.col("of")).groupBy("text").agg(F.array_sort(F.collect_list(F.struct("df", "gram"))).alias("o"))
    grams = ordered.select("text", F.transform("o", lambda x: x["gram"]).alias("grams"))
    leading = F.explode(F.slice("grams", F.lit(1), (F.size("grams") - F.ceil(F.size("grams") * least) + 1).cast("int"))).alias("gram")
    left = names.join(grams, F.col("name") == F.col("text")).drop("text").select("*", leading)
    right = known.join(grams.withColumnRenamed("grams", "h"), F.col("known") == F.col("text")).drop("text").select("*", F.explode(F.slice("h", F.lit(1), (F.size("h") - F.ceil(F.size("h") * least) + 1).cast("int"))).alias("gram2"))
    same = F.col("gram") == F.col("gram2")
    own = left.join(right, same & (F.col("court_id") == F.col("court")))
    free = left.join(right.where("court IS NULL"), same)
    any_court = left.where("court_id IS NULL").join(right.where("court IS NOT NULL"), same)
    met = own.unionByName(free).unionByName(any_court).drop("gram", "gram2").distinct()
    near = F.size(F.array_intersect("grams", "h")) / F.size(F.array_union("grams", "h"))
    rank = F.row_number().over(Window.partitionBy("name", "court_id").orderBy(F.desc("near"), "judge_id"))
    return met.withColumn("near", near).where(F.col("near") > least).withColumn("place", rank).where(F.col("place") <= most).drop("near", "place", "grams", "h")


def candidates(names: DataFrame, known: DataFrame) -> DataFrame:
    """Scores of the registry entries in each name's pool.

    names are the distinct (name, court_id) that occur, known the registry. Without a hearing's date the tenure counts half.
    """
    ship(names.sparkSession)
    a, b = F.split("name", " "), F.split("known", " ")
    overlap = F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))
    exact, sound = (F.col("name") == F.col("known")).cast("double"), (F.col("own_sound") == F.col("sound")).cast("double")
    court = F.when(F.col("court").isNull(), 0.4).when(F.col("court") == F.col("court_id"), 1.0).otherwise(0.0)
    scored = pool(names, known).withColumn("own_sound", phonetic_key(F.col("name"))).withColumn("ratio", ratio_of("name", "known"))
    scored = scored.withColumn("ratio", F.when(F.col("ratio") < LOW, 0.8 * F.col("ratio")).otherwise(F.col("ratio")))
    w = WEIGHTS
    total = w["exact"] * exact + w["overlap"] * overlap + w["ratio"] * F.col("ratio") + w["phonetic"] * sound + w["court"] * court + w["tenure"] * 0.5
    kind = F.when(exact == 1, "exact").when(F.col("ratio") >= 0.9, "fuzzy").when(sound == 1, "phonetic").otherwise("manual")
    return scored.select("name", "court_id", "judge_id", F.round(total, 6).alias("score"), kind.alias("kind"))


NAMES_SQL = f", b AS ({BENCH_SQL}), p AS (SELECT DISTINCT unnest(string_split_regex(bench, '\\s*(?:,|&| and |/|\\|)\\s*')) AS part FROM b), nm AS (SELECT part, {NAME_SQL} AS name FROM p)"


@query("ent_1_names", NAMES_SQL + " SELECT part, name FROM nm")
def names_query(t: Tables) -> DataFrame:
    parts = benches(t).select(F.explode(F.split("bench", r"\s*(?:,|&| and |/|\|)\s*")).alias("part")).distinct()
    return parts.select("part", normalised_name(F.col("part")).alias("name"))


#: A fold over words joins single letters that follow each other; a fold over letters, its last digit beside the code so far, makes the code.
PHONETIC_SQL = NAMES_SQL + r""", tk AS (SELECT part, list_filter(string_split(name, ' '), lambda x: x <> '') AS words FROM nm),
mg AS (SELECT part, list_reduce(list_transform(words, lambda w, i: CASE WHEN i > 1 AND length(w) = 1 AND length(words[i - 1]) = 1 THEN w ELSE ' ' || w END), lambda a, x: a || x, '') AS joined FROM tk),
wd AS (SELECT part, list_filter(string_split(joined, ' '), lambda x: x <> '') AS words FROM mg),
cd AS (SELECT part, list_transform(words, lambda w: upper(w[1]) || left(list_reduce(list_transform(string_split(w[2:], ''), lambda c: CASE WHEN c IN ('b', 'f', 'p', 'v') THEN '1' WHEN c IN ('c', 'g', 'j', 'k', 'q', 's', 'x', 'z') THEN '2' WHEN c IN ('d', 't') THEN '3' WHEN c = 'l' THEN '4' WHEN c IN ('m', 'n') THEN '5' WHEN c = 'r' THEN '6' ELSE '-' END),
  lambda a, d: CASE WHEN d = '-' THEN '-' || a[2:] WHEN d = a[1] THEN a ELSE d || a[2:] || d END, '-')[2:] || '000', 3)) AS codes FROM wd)"""


@query("ent_2_phonetic_keys", PHONETIC_SQL + " SELECT part, coalesce(array_to_string(codes, '-'), '') AS key FROM cd")
def keys_query(t: Tables) -> DataFrame:
    return names_query(t).select("part", phonetic_key(F.col("name")).alias("key"))


VARIANTS_SQL = NAMES_SQL + r""", tk AS (SELECT part, name, list_filter(string_split(name, ' '), lambda x: x <> '') AS words FROM nm),
vr AS (SELECT part, [name, array_to_string(list_filter(words, lambda x: length(x) > 1), ' ')] || CASE WHEN len(words) > 1 THEN [array_to_string(list_transform(words[1:len(words) - 1], lambda x: x[1] || '.') || [words[len(words)]], ' '), array_to_string(list_reverse(words), ' ')] ELSE [] END AS forms FROM tk)"""


@query("ent_3_variants", VARIANTS_SQL + " SELECT part, array_to_string(list_sort(list_distinct(list_filter(forms, lambda x: x <> ''))), '|') AS variants FROM vr")
def variants_query(t: Tables) -> DataFrame:
    return names_query(t).select("part", F.array_join(variants(F.col("name")), "|").alias("variants"))


def all_candidates(t: Tables) -> DataFrame:
    return candidates(bench_tokens(t).select("name", "court_id").distinct(), registry(t))


@query("ent_5_candidates")
def candidate_query(t: Tables, k: int = 10) -> DataFrame:
    """The ten best entries of each name and court."""
    rank = F.row_number().over(Window.partitionBy("name", "court_id").orderBy(F.desc("score"), "judge_id"))
    return all_candidates(t).withColumn("rn", rank).where(F.col("rn") <= k).drop("rn")


def resolved(t: Tables, least: float = LEAST) -> DataFrame:
    """The best entry of each name and court, or a new provisional one, named by name and court, where none scores enough."""
    best = all_candidates(t).groupBy("name", "court_id").agg(F.max(F.struct("score", (-F.col("judge_id")).alias("j"), "kind")).alias("b"))
    names = bench_tokens(t).select("name", "court_id").distinct()
    met = names.join(best, ["name", "court_id"], "left").withColumn("judge_id", F.when(F.col("b.score") >= least, -F.col("b.j")))
    created = F.concat(F.lit("new-"), F.left(F.md5(F.concat_ws("|", "name", F.col("court_id").cast("string")).cast("binary")), F.lit(12)))
    return met.select("name", "court_id", "judge_id", F.coalesce(F.col("judge_id").cast("string"), created).alias("entry"), F.coalesce("b.kind", F.lit("no_match")).alias("kind"), F.coalesce("b.score", F.lit(0.0)).alias("score"))


@query("ent_6_resolved")
def resolved_query(t: Tables) -> DataFrame:
    return resolved(t)


def long_names(t: Tables, table: str, key: str) -> DataFrame:
    """(id, name): a longer name of each supplier or customer: nation, market segment where there is one, and its own name."""
    rows = t.read(table).join(t.read("nation"), F.col(f"{key}_nationkey") == F.col("n_nationkey"))
    parts = ["n_name", *(["c_mktsegment"] if key == "c" else []), f"{key}_name"]
    return rows.select(F.col("s_suppkey" if key == "s" else "c_custkey").alias("id"), normalised_name(F.concat_ws(" ", *parts)).alias("name"))


_TERMS_SQL = "unnest(flatten([list_transform(range(1, len(w) + 2 - n), lambda i: array_to_string(w[i:i + n - 1], ' ')) for n in [1, 2, 3] if len(w) >= n])) AS term"


@query(
    "ent_6_neighbours",
    f""", s AS (SELECT DISTINCT lower(n_name) || ' ' || replace(lower(s_name), '#', ' ') AS name FROM supplier JOIN nation ON s_nationkey = n_nationkey),
    c AS (SELECT DISTINCT lower(n_name) || ' ' || lower(c_mktsegment) || ' ' || replace(lower(c_name), '#', ' ') AS name FROM customer JOIN nation ON c_nationkey = n_nationkey),
    sw AS (SELECT name, list_filter(string_split(name, ' '), lambda x: length(x) > 1) AS w FROM s), cw AS (SELECT name, list_filter(string_split(name, ' '), lambda x: length(x) > 1) AS w FROM c),
    st AS (SELECT name, {_TERMS_SQL} FROM sw), ct AS (SELECT name, {_TERMS_SQL} FROM cw),
    idf AS (SELECT term, ln((1.0 + (SELECT count(*) FROM s)) / (1.0 + count(DISTINCT name))) + 1 AS idf FROM st GROUP BY 1),
    sv AS (SELECT name, term, count(*) * idf AS v FROM st JOIN idf USING (term) GROUP BY name, term, idf), cv AS (SELECT name, term, count(*) * idf AS v FROM ct JOIN idf USING (term) GROUP BY name, term, idf),
    sn AS (SELECT name, term, v / sqrt(sum(v * v) OVER (PARTITION BY name)) AS v FROM sv), cn AS (SELECT name, term, v / sqrt(sum(v * v) OVER (PARTITION BY name)) AS v FROM cv),
    p AS (SELECT cn.name AS a, sn.name AS b, round(sum(cn.v * sn.v), 9) AS cosine FROM cn JOIN sn USING (term) GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY cosine DESC, b) AS place FROM p)
    SELECT a AS name, b AS nearest, CAST(place AS INTEGER) AS place, round({NEIGHBOUR} * cosine, 6) AS score FROM r WHERE place <= 5""",
)
def neighbours(t: Tables, k: int = 5) -> DataFrame:
    """The five nearest registry names of each name by TF-IDF of one to three words; three quarters of the cosine are its confidence."""
    found = nearest(long_names(t, "customer", "c"), long_names(t, "supplier", "s"), k)
    return found.select(F.col("a").alias("name"), F.col("b").alias("nearest"), "place", F.round(NEIGHBOUR * F.col("cosine"), 6).alias("score"))


@query("ent_7_assignments")
def assignments(t: Tables) -> DataFrame:
    """A row for each judge of a bench with the entry it is resolved to, or the one made for it."""
    confidence = F.when(F.col("judge_id").isNull(), F.greatest(F.lit(FLOOR), "score")).otherwise(F.col("score"))
    return bench_tokens(t).join(resolved(t), ["name", "court_id"]).select("case_id", "seq", "name", "judge_id", "entry", "role", "kind", confidence.alias("confidence"))


@query("fil_8_judge_review")
def judge_review(t: Tables, threshold: float = 0.75) -> DataFrame:
    """Assignments below a confidence, by case from the newest."""
    return assignments(t).where(F.col("confidence") < threshold).select("case_id", "seq", "name", "confidence").orderBy(F.desc("case_id"), "seq")


@query("fil_8_provisional")
def provisional_listing(t: Tables) -> DataFrame:
    """The entries that had to be made, with the cases that name them and the newest one."""
    made = assignments(t).where("judge_id IS NULL")
    return made.groupBy("entry", "name").agg(F.count_distinct("case_id").alias("cases"), F.max("case_id").alias("newest")).orderBy(F.desc("newest"), "entry")


def entries(t: Tables) -> DataFrame:
    """(id, court, name, seen): provisional entries. The first two words of a document stand in for a name; court and day follow from its number."""
    words = F.slice(F.filter(F.split(normalised_name(F.left(F.coalesce("text", F.lit("")), F.lit(200))), " "), lambda w: w != ""), 1, 2)
    n = F.col("doc_id")
    return t.read("documents").select(n.alias("id"), (n % 25).cast("int").alias("court"), F.array_join(words, " ").alias("name"), F.date_sub(t.as_of, (n * 37 % 800).cast("int")).alias("seen"))


def entry_groups(given: DataFrame) -> DataFrame:
    """(name, court, newest): the entries of one name and court."""
    return checkpoint(given.where("name <> ''").groupBy("name", "court").agg(F.max("id").alias("newest")))


def equal_names(given: DataFrame, groups: DataFrame) -> DataFrame:
    """(id, other, score): entries of one name and court linked to the newest of them, and groups of one name to the newest group."""
    same = given.join(groups.withColumnsRenamed({"name": "n", "court": "c"}), (F.col("name") == F.col("n")) & F.col("court").eqNullSafe(F.col("c"))).where("id <> newest").select(F.col("newest").alias("id"), F.col("id").alias("other"), F.lit(MERGE_CAP).alias("score"))
    heads = groups.groupBy(F.col("name").alias("n")).agg(F.max("newest").alias("head"))
    return same.unionByName(groups.join(heads, F.col("name") == F.col("n")).where("newest <> head").select(F.col("head").alias("id"), F.col("newest").alias("other"), F.lit(MERGE_CAP).alias("score")))


def scored_pairs(groups: DataFrame, pairs: DataFrame, least: float = MERGE) -> DataFrame:
    """(id, other, score) of the groups whose names are pairs (a, b, ratio) and whose score is at least as high."""
    sounds = groups.select(F.col("name").alias("n"), phonetic_key(F.col("name")).alias("sound")).distinct()
    for side in ("a", "b"):
        pairs = pairs.join(sounds.select(F.col("n"), F.col("sound").alias(f"sound_{side}")), F.col(side) == F.col("n")).drop("n")
    pairs = checkpoint(pairs.withColumn("base", F.col("ratio") + F.when(F.col("sound_a") == F.col("sound_b"), 0.05).otherwise(0.0)))
    left, right = groups.select(F.col("name").alias("na"), F.col("court").alias("ca"), F.col("newest").alias("ia")), groups.select(F.col("name").alias("nb"), F.col("court").alias("cb"), F.col("newest").alias("ib"))
    met = pairs.select("a", "b", "base").join(left, F.col("a") == F.col("na"))
    # Where the common court is needed it is part of the key; half a millionth is what rounding can add.
    one = met.where(F.col("base") < least - 1e-6).join(right, (F.col("b") == F.col("nb")) & (F.col("ca") == F.col("cb")))
    any_court = met.where(F.col("base") >= least - 1e-6).join(right, F.col("b") == F.col("nb"))
    scored = one.unionByName(any_court).withColumn("score", F.round(F.col("base") + F.when(F.col("ca") == F.col("cb"), 0.05).otherwise(0.0), 6)).where(F.col("score") >= least)
    return scored.select(F.greatest("ia", "ib").alias("id"), F.least("ia", "ib").alias("other"), F.least(F.lit(MERGE_CAP), "score").alias("score"))


def merge_pairs(given: DataFrame) -> DataFrame:
    """(id, other, score): entries (id, court, name) that may be one person, without loss over all of them.

    The likeness of the names counts, a common court and a common sound add 0.05 each. Entries of one name and court are
    linked to the newest of them, and such groups of one name to the newest group, instead of each to each; groups of
    different names are linked by their newest entries, wherever the score is reached. Entries without a name are left out.
    """
    groups = entry_groups(given)
    return equal_names(given, groups).unionByName(scored_pairs(groups, alike(groups.select("name"), round(100 * (MERGE - 0.10)))))


def best_merges(given: DataFrame, most: int) -> DataFrame:
    """The first rows of merge_pairs by score, id and other, from the highest.

    Entries of equal names have the highest score there is. Where they are as many as asked for, a pair of different names comes
    among the first only with that score and an id not below the last of them; so only names of entries as new as that
    are compared, with those of all entries.
    """
    order = [F.desc("score"), F.desc("id"), F.desc("other")]
    groups = entry_groups(given)
    first = checkpoint(equal_names(given, groups).orderBy(*order).limit(most))
    n, last = first.agg(F.count(F.lit(1)), F.min("id")).first()
    if n < most:
        return merge_pairs(given).orderBy(*order).limit(most)
    pairs = alike_to(groups.where(F.col("newest") >= last).select("name"), groups.select("name"), round(100 * (MERGE_CAP - 0.10)) - 1)
    return first.unionByName(scored_pairs(groups, pairs, MERGE_CAP).where(F.col("id") >= last)).orderBy(*order).limit(most)


@query("ent_8_merges")
def merges(t: Tables, most: int = SUGGESTIONS) -> DataFrame:
    """The best suggestions over all provisional entries; their number is a limit of the report."""
    return best_merges(entries(t), most)


@query("ent_8_stale", f"SELECT doc_id AS id, DATE '2001-12-31' - CAST(doc_id * 37 % 800 AS INTEGER) AS seen FROM documents WHERE doc_id * 37 % 800 > {STALE}")
def stale(t: Tables, days: int = STALE) -> DataFrame:
    """Provisional entries that were not seen for so many days."""
    return entries(t).where(F.col("seen") < F.date_sub(t.as_of, days)).select("id", "seen")


def official_links(parties: DataFrame, known: DataFrame, threshold: int = TOKEN_SET) -> DataFrame:
    """(party, official, confidence): the official most like each party's name, the first of equals.

    parties (party, name) and known (official, name) meet without loss on their distinct normalised names; equal names are
    compared once, and the best official of a name is chosen before it goes back to the parties.
    """
    own = parties.select("party", normalised_name(F.col("name")).alias("norm"))
    first = known.select("official", normalised_name(F.col("name")).alias("other")).groupBy("other").agg(F.min("official").alias("official"))
    scored = alike_word_sets(own.select(F.col("norm").alias("name")), first.select(F.col("other").alias("name")), threshold)
    best = scored.join(first, F.col("b") == F.col("other")).groupBy("a").agg(F.max(F.struct("score", (-F.col("official")).alias("o"))).alias("best"))
    return own.join(best, F.col("norm") == F.col("a")).select("party", (-F.col("best.o")).alias("official"), F.round(F.col("best.score") / 100, 2).alias("confidence"))


def officials(t: Tables) -> DataFrame:
    """Parties are customers and, as negative numbers, the first words of documents; officials a list and the first words of benchmark passages."""
    two = lambda c: F.array_join(F.slice(F.split(F.trim(F.left(F.coalesce(c, F.lit("")), F.lit(200))), r"\s+"), 1, 2), " ").alias("name")
    parties = named(t, PARTIES, "party", "customer", "c_custkey").unionByName(t.read("documents").select((-F.col("doc_id") - 1).alias("party"), two(F.col("text"))))
    listed = t.spark.createDataFrame([(i, n) for i, n in enumerate(OFFICIALS)], "official long, name string")
    return official_links(parties, listed.unionByName(t.read("benchmark").select((F.col("item_id") + len(OFFICIALS)).cast("long").alias("official"), two(F.col("text")))))


@query("ent_9_officials")
def officials_query(t: Tables) -> DataFrame:
    return officials(t)


@query("join_11_fuzzy")
def fuzzy_join(t: Tables) -> DataFrame:
    """How many parties each official was found for."""
    return officials(t).groupBy("official").agg(F.count(F.lit(1)).alias("parties"), F.min("confidence").alias("least"))
