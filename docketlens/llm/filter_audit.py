"""Filter interaction audit: what each of five filters removes, in every order in which they can be applied.

The texts are measured by a table-driven transducer over their UTF-8 bytes: each byte has a class, the state before it is
outside or inside a word, and a table gives for state and class the next state and what to emit (a word's start or end, a
code point, a capital, a symbol). The automaton forgets all but the last byte, so the pass runs over arrays of bytes.
Its word spans go into an open hash table under a rolling hash; a span that meets an occupied slot is compared byte by byte
with the span there, and only then counts as the same word.

Which filters a text fails decides all else, so that documents come down to counts by part and set of failed filters.
"""

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docketlens.llm.common import checkpoint, ship

#: Classes of bytes, states, and what a step emits (bits).
GAP, PLAIN, CAPITAL, SYMBOL, LEAD, TAIL = range(6)
OUTSIDE, INSIDE = range(2)
START, END, POINT, CAPITALS, SYMBOLS = 1, 2, 4, 8, 16
FILTERS = "ABCDE"
ORDERS = tuple("".join(p) for p in itertools.permutations(FILTERS))
#: Bytes of texts that are measured at a time.
BLOCK = 1 << 20
MEASURES = ("n_words", "n_distinct", "n_capitals", "n_points", "n_symbols")


def byte_classes() -> np.ndarray:
    out = np.full(256, PLAIN, np.uint8)
    out[0x80:0xC0], out[0xC0:] = TAIL, LEAD
    out[[0x20, *range(0x09, 0x0E)]] = GAP
    out[ord("A") : ord("Z") + 1] = CAPITAL
    out[[ord(c) for c in "#$%&*|"]] = SYMBOL
    return out


CLASS = byte_classes()
#: NEXT[class] is the state after a byte, whatever it was before; EMIT[state, class] what the byte gives.
NEXT = np.array([OUTSIDE, INSIDE, INSIDE, INSIDE, INSIDE, INSIDE], np.uint8)
_each = np.array([POINT, POINT, POINT | CAPITALS, POINT | SYMBOLS, POINT, 0], np.uint8)
EMIT = np.array([_each | np.where(NEXT == INSIDE, START, 0), _each | np.where(NEXT == OUTSIDE, END, 0)], np.uint8)

#: Base of the rolling hash and its inverse modulo 2**64, and factors that mix a text's number and a length into it.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
MIX_TEXT, MIX_LENGTH, MIX = np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9), np.uint64(0xD6E8FEB86659FD93)


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether the spans of equal length that start at a and b have the same bytes."""
    ends = np.cumsum(length)
    inside = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - length, length)
    differ = data[np.repeat(a, length) + inside] != data[np.repeat(b, length) + inside]
    total = np.concatenate([[0], np.cumsum(differ)])
    return total[ends] == total[ends - length]


def distinct_spans(data: np.ndarray, start: np.ndarray, length: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Numbers of the spans that are the first of their word in their text, by a verified open hash table."""
    n = len(start)
    if not n:
        return np.zeros(0, np.int64)
    prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(data)))])
    rolled = (prefix[start + length] - prefix[start]) * powers(INVERSE, len(data) + 1)[start]
    bits = max(4, int(2 * n - 1).bit_length())
    mask = (1 << bits) - 1
    hashed = (rolled ^ text.astype(np.uint64) * MIX_TEXT ^ length.astype(np.uint64) * MIX_LENGTH) * MIX
    slot = (hashed >> np.uint64(64 - bits)).astype(np.int64)
    table = np.full(mask + 1, -1, np.int64)
    waiting = np.arange(n)
    while len(waiting):
        at = slot[waiting]
        free = table[at] < 0
        # Of several spans that want one free slot the first one gets it.
        table[at[free][::-1]] = waiting[free][::-1]
        held = table[at]
        same = held == waiting
        likely = np.flatnonzero(~same & (hashed[held] == hashed[waiting]) & (text[held] == text[waiting]) & (length[held] == length[waiting]))
        same[likely] = same_bytes(data, start[waiting[likely]], start[held[likely]], length[waiting[likely]])
        waiting = waiting[~same]
        slot[waiting] = (slot[waiting] + 1) & mask
    return np.sort(table[table >= 0])


def transduce(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """measures (a row for each text, as in MEASURES), data, and start, length and text of the distinct spans."""
    data = np.frombuffer(b" ".join([*texts, b""]), np.uint8)  # a gap ends each text
    lengths = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(lengths + 1)
    kind = CLASS[data]
    before = np.concatenate([[OUTSIDE], NEXT[kind[:-1]]])
    emitted = EMIT[before, kind]
    number = lambda bit: np.diff(np.searchsorted(np.flatnonzero(emitted & bit), np.concatenate([[0], ends])))
    start = np.flatnonzero(emitted & START)
    length = np.flatnonzero(emitted & END) - start
    text = np.searchsorted(ends, start, side="right")
    first = distinct_spans(data, start, length, text)
    words, distinct = np.bincount(text, minlength=len(texts)), np.bincount(text[first], minlength=len(texts))
    measures = np.stack([words, distinct, number(CAPITALS), number(POINT) - 1, number(SYMBOLS)], axis=1)
    return measures, data, start[first], length[first], text[first]


def pieces(text: bytes, block: int) -> Iterator[bytes]:
    """A long text cut between words; a word longer than a block stays whole."""
    at = 0
    while at < len(text):
        end = at + block
        if end < len(text):
            while end > at and CLASS[text[end - 1]] != GAP:
                end -= 1
            if end == at:
                end = at + block
                while end < len(text) and CLASS[text[end - 1]] != GAP:
                    end += 1
        yield text[at : min(end, len(text))]
        at = end


def measure_long(text: bytes, block: int) -> np.ndarray:
    """The measures of a text beyond a block, piece by piece; its distinct words are kept in a set."""
    total, seen = np.zeros(len(MEASURES), np.int64), set()
    for piece in pieces(text, block):
        measures, data, start, length, _ = transduce([piece])
        total += measures[0]
        raw = data.tobytes()
        seen.update(raw[s : s + n] for s, n in zip(start.tolist(), length.tolist(), strict=True))
    total[1] = len(seen)
    return total


def measure(texts: list[bytes], block: int = BLOCK) -> np.ndarray:
    """A row of MEASURES for each text; short texts go through the transducer together."""
    out = np.zeros((len(texts), len(MEASURES)), np.int64)
    group: list[int] = []
    size = 0
    for i in range(len(texts) + 1):
        n = len(texts[i]) if i < len(texts) else 0
        if group and (i == len(texts) or size + n > block):
            out[group] = transduce([texts[k] for k in group])[0]
            group, size = [], 0
        if i < len(texts) and n > block:
            out[i] = measure_long(texts[i], block)
        elif i < len(texts):
            group.append(i)
            size += n
    return out


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, part, digest, n_words, n_distinct, n_capitals, n_points, n_symbols): one row per document, without its text."""
    ship(docs.sparkSession)
    text = F.coalesce("text", F.lit(""))
    given = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), text.cast("binary").alias("bytes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = measure(batch.column(3).to_pylist())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), *(pa.array(rows[:, i]) for i in range(len(MEASURES)))], names=["doc_id", "part", "digest", *MEASURES])

    return given.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, part string, digest binary, " + ", ".join(f"{m} long" for m in MEASURES))


def failures(docs: DataFrame) -> DataFrame:
    """(doc_id, part, fails, n): the letters of the filters that documents fail, and how many such rows there are.

    A text's first document is the one with the smallest doc_id; all others with the text fail E. Documents without
    doc_id are neither smaller nor greater than others and do not fail E.
    """
    letter = lambda failed, name: F.when(failed, name).otherwise("")
    own = F.concat(
        letter(F.col("n_words") < 100, "A"),
        letter(100 * F.col("n_distinct") < 80 * F.col("n_words"), "B"),
        letter(100 * F.col("n_capitals") > 10 * F.col("n_points"), "C"),
        letter(F.col("n_symbols") > 0, "D"),
    )
    # Repeated rows come down to a number before anything is joined, so that no key has many rows.
    rows = checkpoint(measured(docs).select("doc_id", "part", "digest", own.alias("own")).groupBy("doc_id", "part", "digest", "own").agg(F.count(F.lit(1)).alias("n")))
    first = rows.groupBy(F.col("digest").alias("d")).agg(F.min("doc_id").alias("i")).withColumn("first", F.lit(True))
    met = rows.join(first, (F.col("digest") == F.col("d")) & (F.col("doc_id") == F.col("i")), "left")
    copy = F.col("first").isNull() & F.col("doc_id").isNotNull()
    return met.select("doc_id", "part", F.concat("own", letter(copy, "E")).alias("fails"), "n")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for each part, order of the five filters and step, with what the step's filter does there.

    docs needs doc_id, text and lang, labels doc_id, quality and toxic; other columns are ignored. A null text is empty, a
    null lang the part "". A document with several label rows is good or toxic if one of them says so. Repeated rows
    count as often as they stand there. An empty table gives no rows.
    """
    marks = labels.groupBy(F.col("doc_id").alias("l")).agg(F.max((F.col("quality") == 1).cast("long")).alias("good"), F.max((F.col("toxic") == 1).cast("long")).alias("toxic"))
    each = failures(docs).join(marks, F.col("doc_id") == F.col("l"), "left")
    share = lambda mark: F.sum(F.col("n") * F.coalesce(mark, F.lit(0))).alias(mark)
    counts = each.groupBy("part", "fails").agg(F.sum("n").alias("n"), share("good"), share("toxic"))
    orders = F.array(*[F.lit(o) for o in ORDERS])
    place = counts.select("*", F.explode(F.sequence(F.lit(0), F.lit(5 * len(ORDERS) - 1))).alias("k"))
    place = place.select("*", F.get(orders, F.floor(F.col("k") / 5).cast("int")).alias("filter_order"), (F.col("k") % 5 + 1).cast("int").alias("step"))
    place = place.withColumn("letter", F.substr("filter_order", F.col("step"), F.lit(1))).withColumn("earlier", F.left("filter_order", F.col("step") - 1))
    gone, fails = F.expr("translate(earlier, fails, '') <> earlier"), F.col("fails").contains(F.col("letter"))
    total = lambda when, what="n": F.sum(F.when(when, F.col(what)).otherwise(0)).cast("long")
    steps = place.groupBy("part", "filter_order", "step", "letter").agg(
        total(~gone & ~fails).alias("kept"),
        total(~gone & fails).alias("removed"),
        total(gone & fails).alias("redundant"),
        total(F.col("fails") == F.col("letter")).alias("unique_fails"),
        total(~gone & fails, "good").alias("good_lost"),
        total(~gone & fails, "toxic").alias("toxic_lost"),
    )
    # 120 rows for each part and filter.
    return steps.select("*", F.sum("removed").over(Window.partitionBy("part", "letter")).alias("shapley")).drop("letter")
