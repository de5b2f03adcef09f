"""Toxicity by class-conditional Kneser-Ney models.

A word is a chain of characters between a mark for its start and one for its end. Each class, toxic and ordinary, has a
model of the next character after up to four others of the word, with Kneser-Ney's absolute discounts: the highest order
counts occurrences, the orders below count distinct characters on the left. Contexts of two characters and more have the
counts of their class; below them both classes back off to counts that they share, so that what is rare in one class is
judged by what is known of both and an unknown word says nothing. So a word that was never seen, in a new inflection say, is
judged by the parts that were. A toxic text is for the most part ordinary: its words come from the toxic model with the
probability SHARE and else from the ordinary one, so that a word which the few toxic texts happen to lack says little. A
text's score is the difference of its two log-likelihoods for each word, which a logistic curve turns into a probability.

The models learn from labelled rows of three folds, the curve from those of a fourth one, which the models have not seen.
"""

import math
import uuid

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketlens.llm.common import bounded_broadcast, checkpoint, shared_folder

#: Characters of a gram with the one that is predicted; grams up to SHARED characters have counts of both classes.
ORDER, SHARED = 5, 2
FOLDS, HELD_OUT, CURVE = 5, 0, 4
FIRST, LAST = "\u0002", "\u0003"
TOKEN = r"[\p{L}\p{M}]+"
#: Words with most occurrences whose values are broadcast; all others are joined by a shuffle.
FREQUENT = 100_000
#: Share of a toxic text's words that the toxic model gives, and the largest difference for a word that still fits a double.
SHARE, LARGEST = 0.02, 500.0
CLASSES = ("ordinary", "toxic")


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def grams(word: Column) -> Column:
    """For each character of a word and its end: the characters before it, four at most, and itself."""
    chain = F.concat(F.array(F.lit(FIRST)), F.filter(F.split(word, ""), lambda c: c != ""), F.array(F.lit(LAST)))
    one = lambda c: F.transform(F.sequence(F.lit(2), F.size(c)), lambda i: F.array_join(F.slice(c, F.greatest(F.lit(1), i - (ORDER - 1)), F.least(F.lit(ORDER), i)), ""))
    return F.element_at(F.transform(F.array(chain), one), 1)


def fold(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS, F.lit(-1))


def marked(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, fold, toxic, text); a document with several label rows is toxic if one of them says so, null without any."""
    known = bounded_broadcast(labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("l")).agg(F.max("toxic").alias("toxic")))
    return docs.select("doc_id", "text").join(known, F.col("doc_id") == F.col("l"), "left").select("doc_id", fold(F.col("doc_id")).alias("fold"), "toxic", "text")


def stored(df: DataFrame) -> DataFrame:
    """df, written to the shared folder and read again: a table of words is much smaller as Parquet than as a checkpoint."""
    df.write.parquet(path := f"{shared_folder(df.sparkSession)}/toxicity-{uuid.uuid4().hex}")
    return df.sparkSession.read.parquet(path)


def word_counts(rows: DataFrame) -> DataFrame:
    """(word, n, ordinary, toxic): occurrences in all texts, and in those of each class that the models learn from."""
    learn = ~F.col("fold").isin(HELD_OUT, CURVE, -1)
    each = rows.select(F.when(learn, F.col("toxic")).alias("label"), F.explode(tokens(F.col("text"))).alias("word"))
    return each.groupBy("word").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("label") == i).alias(c) for i, c in enumerate(CLASSES)])


def levels(counts: DataFrame) -> dict[int, DataFrame]:
    """By length of the gram: (gram, ordinary, toxic, both), zero for grams that only occur in texts without a label.

    Grams at a word's start have nothing on their left and keep their occurrences at each length. All others count, below
    the full length, the distinct characters before them: in each class, and in both together.
    """
    full = counts.select(F.explode(grams(F.col("word"))).alias("gram"), *CLASSES).groupBy("gram").agg(*[F.sum(c).alias(c) for c in CLASSES])
    full = checkpoint(full.withColumn("both", F.col("ordinary") + F.col("toxic")))
    out = {ORDER: full.where(F.char_length("gram") == ORDER)}
    for n in range(ORDER - 1, 0, -1):
        own = full.where(F.char_length("gram") == n)
        shorter = out[n + 1].groupBy(F.substr("gram", F.lit(2)).alias("gram")).agg(*[F.count_if(F.col(c) > 0).alias(c) for c in (*CLASSES, "both")])
        out[n] = checkpoint(own.unionByName(shorter)) if n > 1 else shorter
    return out


def discount(counts: DataFrame, column: str) -> float:
    once, twice = counts.agg(F.count_if(F.col(column) == 1), F.count_if(F.col(column) == 2)).first()
    return once / (once + 2 * twice) if once else 0.75


def gram_values(counts: DataFrame) -> DataFrame:
    """(gram, value): the logarithm of the toxic model's probability over the ordinary one's, for all grams of the texts' words.

    Goes from single characters up: each length needs the probabilities of the one below, found under the gram without its
    first character. All tables are keyed by grams; a context's totals are a window over the grams that it begins.
    """
    by_length = levels(counts)
    below, parts = None, []
    for n in range(1, ORDER + 1):
        level = by_length[n].withColumn("context", F.left("gram", F.lit(n - 1)))
        whole = Window.partitionBy("context")
        sources = ("both", "both") if n <= SHARED else CLASSES
        if below is None:
            known = level.withColumn("lower", F.lit(1.0 / (by_length[1].count() + 1))).select("*", *[F.col("lower").alias(f"lower_{c}") for c in CLASSES])
        else:
            known = level.join(below, F.substr("gram", F.lit(2)) == F.col("shorter"))
        share = []
        for c, source in zip(CLASSES, sources, strict=True):
            d, total = discount(by_length[n], source), F.sum(source).over(whole)
            kinds = F.count_if(F.col(source) > 0).over(whole)
            p = (F.greatest(F.col(source) - d, F.lit(0.0)) + d * kinds * F.col(f"lower_{c}")) / total
            share.append(F.when(total > 0, p).otherwise(F.col(f"lower_{c}")).alias(f"p_{c}"))
        found = checkpoint(known.select("gram", *share))
        below = found.select(F.col("gram").alias("shorter"), *[F.col(f"p_{c}").alias(f"lower_{c}") for c in CLASSES])
        parts.append(found.where((F.char_length("gram") == ORDER) | F.col("gram").startswith(FIRST)))
    out = parts[1]
    for part in parts[2:]:
        out = out.unionByName(part)
    return out.select("gram", (F.log("p_toxic") - F.log("p_ordinary")).alias("value"))


def word_values(counts: DataFrame) -> DataFrame:
    """(word, n, value): the sum over a word's grams."""
    values = bounded_broadcast(checkpoint(gram_values(counts)).withColumnRenamed("gram", "g"))
    each = counts.select("word", "n", F.explode(grams(F.col("word"))).alias("gram")).join(values, F.col("gram") == F.col("g"))
    return each.groupBy("word").agg(F.first("n").alias("n"), F.sum("value").alias("value"))


def gain(value: Column) -> Column:
    """What a word adds to the difference of a text's log-likelihoods."""
    return F.log(1 - SHARE + SHARE * F.exp(F.least(value, F.lit(LARGEST))))


def likelihoods(rows: DataFrame, words: DataFrame) -> DataFrame:
    """(doc_id, fold, toxic, ratio): the difference of a text's log-likelihoods for each word, 0 without words.

    The values of the most frequent words are broadcast; so the key of a word that all texts have is never shuffled. Other
    words meet theirs in a join. A text is known by its doc_id and hash, so that repeated rows have one ratio.
    """
    frequent = F.broadcast(words.orderBy(F.desc("n"), "word").limit(FREQUENT).select(F.col("word").alias("w"), gain(F.col("value")).alias("known")))
    texts = rows.withColumn("hash", F.xxhash64("text"))
    each = texts.select("doc_id", "hash", F.explode(tokens(F.col("text"))).alias("word"))
    same = F.col("word") == F.col("w")
    rare = each.join(frequent, same, "left_anti").join(words.select(F.col("word").alias("w"), gain(F.col("value")).alias("known")), same)
    sums = [part.groupBy("doc_id", "hash").agg(F.count(F.lit(1)).alias("n"), F.sum("known").alias("known")) for part in (each.join(frequent, same), rare)]
    both = sums[0].unionByName(sums[1])
    ratios = both.groupBy(F.col("doc_id").alias("i"), F.col("hash").alias("h")).agg((F.sum("known") / F.sum("n")).alias("ratio"))
    joined = texts.join(ratios, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("hash") == F.col("h")), "left")
    return joined.select("doc_id", "fold", "toxic", F.coalesce("ratio", F.lit(0.0)).alias("ratio"))


def curve(ratios: DataFrame) -> tuple[float, float]:
    """Slope and intercept of the logistic curve; without both labels a constant, the share of toxic rows."""
    own = ratios.where((F.col("fold") == CURVE) & F.col("toxic").isNotNull()).select(F.col("ratio"), (F.col("toxic") == 1).cast("double").alias("label"))
    n, toxic = own.agg(F.count(F.lit(1)), F.sum("label")).first()
    if not n or toxic in (0, n):
        share = min(max((toxic or 0) / n if n else 0.0, 1e-6), 1 - 1e-6)
        return 0.0, math.log(share / (1 - share))
    model = LogisticRegression(regParam=1e-4, maxIter=100).fit(own.select(array_to_vector(F.array("ratio")).alias("features"), "label"))
    return float(model.coefficients[0]), float(model.intercept)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, ratio, score, predicted) for each row of docs.

    docs needs doc_id and text, labels doc_id and toxic; other columns are ignored. A null or empty text, and one without
    letters, has the ratio 0 and the score of that. Rows without doc_id are scored and never held out. Without labels
    of both classes in the curve's fold the score is one constant. An empty table gives no rows. A word's length is
    not bounded: its characters are read once.
    """
    rows = marked(docs, labels)
    words = stored(word_values(stored(word_counts(rows))))
    ratios = stored(likelihoods(rows, words))
    slope, start = curve(ratios)
    score = F.round(1 / (1 + F.exp(-(F.lit(slope) * F.col("ratio") + start))), 9)
    scored = ratios.select("doc_id", (F.col("fold") == HELD_OUT).alias("held_out"), "ratio", score.alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
