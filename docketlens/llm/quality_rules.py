"""Quality rules: word and repetition counts of each text, and the frequency of its lines among the documents of its host.

Lines are normalised (lower case, digits to 0, white space folded, trimmed) and hashed together with their host. A
line counts once for each group of near copies among the host's texts that have it, so that copies of one document
do not make its lines frequent. Lines found in more groups than MAX_DOCS and than SHARE of the host's distinct texts are
removed, so that a host may grow; a document of which less than min_share of the words is left is depleted and
rejected. Only texts with a line that passes the limit before copies are grouped are looked at for near copies: each
is held against the first text of its host for each of its smallest word pair hashes, by bottom-k sketches, which are
exact up to SKETCH word pairs and an estimate above. All of it runs on DataFrame functions.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketlens.llm.common import BROADCAST_ROWS, GAP, WORD, bounded_broadcast, checkpoint, let

#: Lines in more texts of one host than this, and than this share of the host's distinct texts, are boilerplate.
MAX_DOCS = 20
SHARE = 0.04
#: Texts that share so many percent of their word pairs are near copies; hashes in a sketch, and those that find partners.
NEAR_PERCENT, SKETCH, KEYS = 75, 128, 8
#: The share of its words that a document must keep.
MIN_SHARE = 0.3
#: Words in a window for repeated words.
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, GAP), lambda w: w != "")


def repeated_words(words: Column) -> Column:
    """How many words stand in a window of eight that the text has twice or more."""

    def covered(windows: Column) -> Column:
        # Window positions whose hash has a twin next to it in sorted order, back in text order.
        def twins(s: Column) -> Column:
            hit = F.filter(F.transform(s, lambda x, i: F.when((x["h"] == F.get(s, i - 1)["h"]) | (x["h"] == F.get(s, i + 1)["h"]), x["p"])), lambda p: p.isNotNull())
            # Each hit covers eight words, or as many as there are before the next one.
            return let(F.array_sort(hit), lambda at: F.aggregate(F.transform(at, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(at, i + 1) - p, F.lit(WINDOW)))), F.lit(0).cast("long"), lambda a, x: a + x))

        pairs = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("long")).otherwise(let(pairs, twins))

    windows = F.transform(F.sequence(F.lit(1), F.size(words) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(words, i, WINDOW)))
    return F.when(F.size(words) <= WINDOW, F.lit(0).cast("long")).otherwise(let(windows, covered))


def normalised(line: Column) -> Column:
    return F.regexp_replace(F.trim(F.regexp_replace(F.lower(line), GAP, " ")), "[0-9]", "0")


def _host(source: Column) -> Column:
    return F.xxhash64(source.isNull(), F.coalesce(source, F.lit("")))


def _row_key() -> Column:
    return F.xxhash64(F.col("doc_id").isNull(), "doc_id", F.col("source").isNull(), "source", F.col("text").isNull(), "text")


def _limits(docs: DataFrame) -> DataFrame:
    """(of_host, most) of the hosts whose limit is above MAX_DOCS."""
    texts = docs.where(F.col("text").isNotNull()).select(_host(F.col("source")).alias("of_host"), F.xxhash64("text").alias("of")).distinct()
    return texts.groupBy("of_host").agg((F.count(F.lit(1)) * SHARE).alias("most")).where(F.col("most") > MAX_DOCS)


def _sketch(text: Column) -> Column:
    """The smallest distinct hashes of the text's pairs of neighbouring words, sorted."""
    pairs = let(words_of(F.lower(text)), lambda w: F.transform(w, lambda x, i: F.xxhash64(x, F.coalesce(F.get(w, i + 1), F.lit("")))))
    return F.slice(F.array_sort(F.array_distinct(pairs)), 1, SKETCH)


def _alike(a: Column, b: Column) -> Column:
    """Whether the likeness of two sketched sets reaches NEAR_PERCENT: common hashes among the smallest of both."""
    return let(F.slice(F.array_sort(F.array_union(a, b)), 1, SKETCH), lambda u: F.size(F.array_intersect(F.array_intersect(u, a), b)) * 100 >= NEAR_PERCENT * F.size(u))


def _near_groups(docs: DataFrame, holders: DataFrame) -> DataFrame:
    """(host, holder, leader): for each of the holders' texts the smallest key of the texts that lead it, its own included."""
    texts = docs.select(_host(F.col("source")).alias("host"), F.xxhash64("text").alias("holder"), "text")
    texts = texts.join(bounded_broadcast(holders, BROADCAST_ROWS), (F.col("host") == F.col("of_host")) & (F.col("holder") == F.col("of")), "left_semi")
    sketches = checkpoint(texts.select("host", "holder", _sketch(F.col("text")).alias("own")).dropDuplicates(["host", "holder"]))
    keys = sketches.select("host", "holder", F.explode(F.slice("own", 1, KEYS)).alias("k"))
    first = keys.groupBy("host", "k").agg(F.min("holder").alias("lead"), F.max("holder").alias("top")).where("lead <> top").drop("top")
    pairs = checkpoint(keys.join(first, ["host", "k"]).where("lead <> holder").select("host", "holder", "lead").distinct())
    leads = pairs.select("host", "lead").distinct().join(sketches.select("host", F.col("holder").alias("lead"), F.col("own").alias("other")), ["host", "lead"])
    led = pairs.join(sketches, ["host", "holder"]).join(bounded_broadcast(leads, BROADCAST_ROWS // 25), ["host", "lead"]).where(_alike(F.col("own"), F.col("other")))
    found = led.groupBy("host", "holder").agg(F.min("lead").alias("lead"))
    return sketches.select("host", "holder").join(found, ["host", "holder"], "left").select("host", "holder", F.coalesce("lead", "holder").alias("leader"))


def _frequent_lines(docs: DataFrame, max_docs: int | None) -> DataFrame:
    """(key, at, line, words) of each removed line: the document's key, the line's number, its hash, its words.

    The counts combine before the shuffle, so that a line of a third of all documents is one row a task. Equal rows of
    documents have one key and count once here. With max_docs distinct texts are counted against it, near copies too.
    """
    # The hashes stand in a projection below the explode, so that a text is hashed once and not for each of its lines.
    hashed = docs.select(_host(F.col("source")).alias("host"), _row_key().alias("key"), F.xxhash64("text").alias("of"), F.coalesce(F.col("text"), F.lit("")).alias("t"))
    lines = hashed.select("host", "key", "of", F.posexplode(F.split("t", "\n"))).where(F.col("col").rlike(WORD))
    line = F.xxhash64("host", normalised(F.col("col"))).alias("line")
    seen = lines.select("host", line, "of").distinct()
    counted = seen.groupBy("host", "line").count().where(F.col("count") > (MAX_DOCS if max_docs is None else max_docs))
    own = lines.select("key", F.col("pos").alias("at"), line, F.regexp_count("col", F.lit(WORD)).alias("words"), "of")
    if max_docs is not None:
        frequent = checkpoint(counted.select("line"))
        return own.join(bounded_broadcast(frequent, BROADCAST_ROWS), "line").dropDuplicates(["key", "at"])
    limited = checkpoint(counted).join(bounded_broadcast(checkpoint(_limits(docs))), F.col("host") == F.col("of_host"), "left")
    limited = checkpoint(limited.select("host", "line", "count", F.coalesce("most", F.lit(float(MAX_DOCS))).alias("most")).where("count > most"))
    held = checkpoint(own.join(bounded_broadcast(limited, BROADCAST_ROWS), "line"))
    groups = _near_groups(docs, held.select(F.col("host").alias("of_host"), "of").distinct())
    pairs = held.select("line", "most", "host", F.col("of").alias("holder")).distinct()
    spread = pairs.join(groups, ["host", "holder"]).select("line", "most", "leader").distinct()
    frequent = checkpoint(spread.groupBy("line", "most").count().where("count > most").select("line"))
    return held.select("key", "at", "line", "words").join(bounded_broadcast(frequent, BROADCAST_ROWS), "line").dropDuplicates(["key", "at"])


def judge(docs: DataFrame, max_docs: int | None = None, min_share: float = MIN_SHARE) -> DataFrame:
    """One row per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, removed_words, base_failed, kept.

    Null texts have no words and fail the base rules. A null source is a host of its own. Repeated rows get equal
    verdicts and count as one document. max_docs takes the place of the growing limit and counts near copies one by
    one, as the SQL does. An empty table gives an empty result.
    """
    base = docs.select("doc_id", "source", "text")
    text = F.coalesce(F.col("text"), F.lit(""))
    counted = base.select("doc_id", _row_key().alias("key"), text.alias("t")).select(
        "doc_id",
        "key",
        F.regexp_count("t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        let(F.filter(F.split("t", "\n"), lambda x: x.rlike(WORD)), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        let(words_of(F.col("t")), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"), repeated_words(w).alias("n_repeat_words"))).alias("w"),
    ).select("doc_id", "key", "w.n_words", "w.word_chars", "n_symbols", "n_dup_lines", "w.n_repeat_words")
    removed = _frequent_lines(base, max_docs).groupBy("key").agg(F.sum("words").alias("removed_words"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    left = F.col("n_words") - F.col("removed_words")
    return (
        counted.join(removed, "key", "left")
        .withColumn("removed_words", F.coalesce("removed_words", F.lit(0)).cast("long"))
        .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "removed_words", failed.alias("base_failed"), (~failed & (left >= min_share * F.col("n_words"))).alias("kept"))
    )


def keep_good(docs: DataFrame, max_docs: int | None = None, min_share: float = MIN_SHARE) -> DataFrame:
    """The documents that judge() keeps, without their removed lines; all columns stay and n_chars is counted anew.

    Repeated rows all stay or go alike. Null and short texts go, and an empty table gives an empty one.
    """
    names = docs.columns
    base = docs.select("doc_id", "source", "text")
    removed = _frequent_lines(base, max_docs).groupBy("key").agg(F.sum("words").alias("removed"), F.array_sort(F.collect_set("at")).alias("at"))
    whole = docs.select(F.struct(*[docs[c] for c in names]).alias("row"), _row_key().alias("key")).join(removed, "key", "left")
    text = F.coalesce(F.col("row.text"), F.lit(""))

    def good(w: Column) -> Column:
        enough = (F.size(w) >= MIN_WORDS) & (F.size(w) - F.coalesce("removed", F.lit(0)) >= min_share * F.size(w))
        return enough & (100 * repeated_words(w) <= MAX_REPEAT_PERCENT * F.size(w))

    def rest(lines: Column) -> Column:
        left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("at"))
        return F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n")

    new = F.when(F.col("at").isNull(), F.col("row.text")).otherwise(let(F.split(text, "\n"), rest))
    # One condition that binds the words once; parts of it would each split the text anew.
    out = whole.where(let(words_of(text), good)).select("row", new.alias("new"))
    columns = {"text": F.col("new")} | ({"n_chars": F.char_length("new").cast(docs.schema["n_chars"].dataType)} if "n_chars" in names else {})
    return out.select(*[columns.get(c, F.col(f"row.`{c}`")).alias(c) for c in names])
