"""Canonical exact fingerprints.

A text is brought to one form (Unicode compatibility normalisation, case folding, white space folded), hashed to 128
bits with two xxhash64 and grouped by that hash. Inside a group of equal hashes the canonical bytes are compared:
texts whose bytes differ from those of the group's first get a number behind the hash. All of it are Spark
functions; normalisation and case folding are those of the ICU library that Spark ships, called by java_method.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from docketlens.llm.common import bounded_broadcast, checkpoint, numbered

#: Unicode white space, which folding turns into single spaces.
SPACES = r"[\s\x85\p{Z}]+"


def canonical(text: Column) -> Column:
    """Normalised, case folded, normalised again as folding can undo it, white space folded and trimmed."""
    compose = lambda c: F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(True))
    folded = F.java_method(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), compose(text), F.lit(True))
    return F.trim(F.regexp_replace(compose(folded), SPACES, " "))


def wide_hash(form: Column) -> Column:
    """128 bits in hexadecimal: two xxhash64 of the bytes, the second one over a leading byte more."""
    half = lambda c: F.lpad(F.lower(F.hex(c)), 16, "0")
    return F.concat(half(F.xxhash64(form)), half(F.xxhash64(F.lit(1), form)))


def _collisions(keyed: DataFrame, texts: DataFrame, digest: Callable[[Column], Column]) -> DataFrame:
    """(hash, form, number): canonical forms that share their hash with another and are not the first of its group.

    Only documents whose hash occurs with more than one raw text are looked at; while these are few, they are broadcast
    and the texts are read where they are, not shuffled. Copies meet in the partial aggregation
    of their task first; what is left in a group are its distinct forms.
    """
    shared = keyed.groupBy("hash").agg((F.min("text_key") != F.max("text_key")).alias("more")).where("more").select("hash")
    chosen = keyed.join(bounded_broadcast(checkpoint(shared)), "hash")
    own = bounded_broadcast(checkpoint(chosen.select("x", "y", "text_key")))
    forms = texts.join(own, ["x", "y", "text_key"]).select(canonical(F.col("text")).alias("form"))
    distinct = forms.select(digest(F.col("form")).alias("hash"), "form").distinct()
    return distinct.withColumn("number", F.row_number().over(Window.partitionBy("hash").orderBy("form")) - 1).where("number > 0")


def fingerprint_edits(docs: DataFrame, digest: Callable[[Column], Column] = wide_hash) -> DataFrame:
    """One row per document: doc_id, n_chars, fingerprint, edited_text, edited_fingerprint, near_edited, near_next.

    The edited text has its last half replaced by the start of the next document's text, by ascending doc_id, null
    last; after the last comes the first. The likeness of two exact fingerprints is 1 if they are equal, else 0. A null
    text counts as empty. Rows that agree in doc_id and text are one document in this order and get equal results;
    documents that share a doc_id follow each other by their hashes. An empty table gives an empty result.

    Texts cross the network once, keyed by document, for both roles in the pair of neighbours; the heads
    that go into edited texts cross it once more.
    """
    # x and y stand for doc_id, null told apart. Both joins read the same columns of texts by plain equality, so that
    # Spark shuffles the texts once and reuses the exchange.
    texts = docs.select(F.coalesce("doc_id", F.lit(0)).alias("x"), F.isnull("doc_id").alias("y"), F.coalesce("text", F.lit("")).alias("text")).withColumn("text_key", F.xxhash64("text"))
    doc_id = F.when(~F.col("y"), F.col("x")).cast(docs.schema["doc_id"].dataType)
    formed = texts.select(doc_id.alias("doc_id"), "x", "y", "text_key", F.char_length("text").cast("long").alias("n_chars"), canonical(F.col("text")).alias("form"))
    keyed = checkpoint(formed.select("doc_id", "x", "y", "text_key", "n_chars", digest(F.col("form")).alias("hash")).dropDuplicates(["x", "y", "text_key"]))
    rows = numbered(keyed, "doc_id", "hash", "text_key")
    n = rows.count()
    after = rows.select(F.col("row_number").alias("at"), F.col("x").alias("next_x"), F.col("y").alias("next_y"), F.col("text_key").alias("next_key"), F.col("hash").alias("next_hash"))
    pairs = checkpoint(rows.join(after, F.col("at") == (F.col("row_number") + 1) % F.lit(max(n, 1))).withColumn("half", F.floor(F.col("n_chars") / 2)).drop("at"))

    own = pairs.select("next_x", "next_y", "next_key", "half", F.col("x").alias("own_x"), F.col("y").alias("own_y"), F.col("text_key").alias("own_key"), "n_chars", "hash", "next_hash")
    heads = texts.join(own, (F.col("x") == F.col("next_x")) & (F.col("y") == F.col("next_y")) & (F.col("text_key") == F.col("next_key")))
    heads = heads.select("own_x", "own_y", "own_key", "n_chars", "hash", "half", "next_hash", "next_x", "next_y", "next_key", F.left("text", F.col("half").cast("int")).alias("head")).dropDuplicates(["own_x", "own_y", "own_key"])
    both = texts.join(heads, (F.col("x") == F.col("own_x")) & (F.col("y") == F.col("own_y")) & (F.col("text_key") == F.col("own_key")))
    edited = F.concat(F.left("text", (F.col("n_chars") - F.col("half")).cast("int")), F.col("head"))
    out = both.withColumn("edited_text", edited).withColumn("edited_form", canonical(F.col("edited_text"))).withColumn("edited_hash", digest(F.col("edited_form")))
    # Only where the two hashes of a row are equal are its canonical bytes needed again.
    out = out.withColumn("same", F.when(F.col("edited_hash") != F.col("hash"), False).otherwise(canonical(F.col("text")) == F.col("edited_form")))
    out = out.withColumn("fingerprint", F.col("hash")).withColumn("next_fingerprint", F.col("next_hash")).withColumn("edited_fingerprint", F.col("edited_hash"))

    collisions = checkpoint(_collisions(keyed, texts, digest))
    if not collisions.isEmpty():
        out = _numbered_forms(out, collisions, keyed, texts)
    differs = (F.col("edited_fingerprint") == F.col("fingerprint")) & ~F.col("same")
    out = out.withColumn("edited_fingerprint", F.when(differs, F.concat("edited_fingerprint", F.lit("-edited"))).otherwise(F.col("edited_fingerprint")))
    like = lambda a, b: (F.col(a) == F.col(b)).cast("double")
    return out.select(doc_id.alias("doc_id"), "n_chars", "fingerprint", "edited_text", "edited_fingerprint", like("fingerprint", "edited_fingerprint").alias("near_edited"), like("fingerprint", "next_fingerprint").alias("near_next"))


def _numbered_forms(out: DataFrame, collisions: DataFrame, keyed: DataFrame, texts: DataFrame) -> DataFrame:
    """out with a number behind each fingerprint whose canonical bytes are not the first of their hash."""
    own = bounded_broadcast(collisions.select(F.col("hash").alias("h"), F.col("form").alias("f"), F.col("number").alias("no")))
    hit = keyed.join(bounded_broadcast(collisions.select(F.col("hash").alias("h")).distinct()), F.col("hash") == F.col("h")).select("x", "y", "text_key")
    forms = texts.join(bounded_broadcast(checkpoint(hit)), ["x", "y", "text_key"]).select("x", "y", "text_key", canonical(F.col("text")).alias("form"))
    numbers = checkpoint(forms.join(own, F.col("form") == F.col("f")).select("x", "y", "text_key", "no").distinct())
    suffixed = lambda c: F.concat(F.col(c), F.coalesce(F.concat(F.lit("-"), F.col("no").cast("string")), F.lit("")))
    for name, x, y, key in (("fingerprint", "x", "y", "text_key"), ("next_fingerprint", "next_x", "next_y", "next_key")):
        at = numbers.select(F.col("x").alias("nx"), F.col("y").alias("ny"), F.col("text_key").alias("nk"), "no")
        out = out.join(at, (F.col(x) == F.col("nx")) & (F.col(y) == F.col("ny")) & (F.col(key) == F.col("nk")), "left").withColumn(name, suffixed(name)).drop("nx", "ny", "nk", "no")
    return out.join(own, (F.col("edited_hash") == F.col("h")) & (F.col("edited_form") == F.col("f")), "left").withColumn("edited_fingerprint", suffixed("edited_fingerprint")).drop("h", "f", "no")
