"""Conversation structure repair by a grammar-compressed dynamic programme.

A conversation's turns become symbols of role and fault. A repair keeps turns, gives them another role, deletes them or
inserts empty ones, so that roles read as an optional system turn and then user and assistant in alternation; the cheapest
one is sought, of equally cheap ones the one whose edits, as letters, come first in ASCII.

What a run of symbols costs from each state of the automaton to each other one is a small matrix over (min, plus), whose
entries also hold the edits, as a rope: a pair of ropes that are joined only when they are read. Re-Pair finds pairs of
symbols that recur over all conversations and makes each one a rule; a rule's matrix is the product of its two parts'
matrices, made once and shared by all conversations that contain it. A conversation's symbols are then a short row of
rules. Two repairs between the same states at the same cost never have edits of which one is the other's beginning (the
longer one would have more insertions and cost more), so that order among edits survives concatenation and products are exact.

Conversations are cut into chunks of at most CHUNK consecutive turns; only chunks pass through the task that settles a
conversation, and no task holds more than one of them and the edits that are not yet settled.
"""

import hashlib
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketlens.llm.common import checkpoint, ship

#: Costs of edits; a truncated turn that stays costs more.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: States: nothing yet, after a system turn, after a user's, after an assistant's; where a conversation may end.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (EMPTY, ASSISTANT)
NEXT = {(EMPTY, "s"): SYSTEM, (EMPTY, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
NAMES = {"u": "user", "a": "assistant"}
#: Symbols: a role's initial (s, u, a or another one) by a fault (none, one that must go, truncated).
INITIALS, FAULTS = "sua?", "kdt"
SYMBOLS = {chr(ord("A") + 3 * i + j): (r, f) for i, r in enumerate(INITIALS) for j, f in enumerate(FAULTS)}
#: Rules are characters from here on. A round picks so many pairs that share no symbol; both bound the grammar, not the data.
FIRST_RULE, RULES, PICKS, ROUNDS = 0x4E00, 256, 16, 24
#: log2 of the turns in a chunk.
BITS = 7
GAPS = r"[\x20\x09-\x0D]"


class Way(NamedTuple):
    """A cheapest way from one state to another: its cost and rope of edits, a string or a pair of ropes."""

    cost: int
    rope: object


def letters(rope) -> str:
    out, todo = [], [rope]
    while todo:
        r = todo.pop()
        if isinstance(r, str):
            out.append(r)
        else:
            todo += (r[1], r[0])
    return "".join(out)


def better(a: Way | None, b: Way) -> Way:
    if a is None or b.cost < a.cost:
        return b
    return b if b.cost == a.cost and letters(b.rope) < letters(a.rope) else a


Matrix = dict[tuple[int, int], Way]


def product(a: Matrix, b: Matrix) -> Matrix:
    out: Matrix = {}
    for (s, k), x in a.items():
        for (k2, t), y in b.items():
            if k == k2:
                out[s, t] = better(out.get((s, t)), Way(x.cost + y.cost, (x.rope, y.rope)))
    return out


def insertions() -> Matrix:
    """Empty turns between two states, as many as it takes."""
    out: Matrix = {}
    for s in range(4):
        t, n = s, 0
        while (s, t) not in out:
            out[s, t] = Way(INSERT * n, "I" * n)
            t, n = NEXT[t, "a" if t == USER else "u"], n + 1
    return out


INSERTED = insertions()


def symbol_matrix(initial: str, fault: str) -> Matrix:
    """Insertions, then the turn itself."""
    own: Matrix = {(s, s): Way(DELETE, "D") for s in range(4)}
    for (s, role), t in NEXT.items():
        if fault != "d":
            more = TRUNCATED if fault == "t" else 0
            if role == initial:
                own[s, t] = better(own.get((s, t)), Way(more, "K"))
            if role in NAMES:
                own[s, t] = better(own.get((s, t)), Way(REROLE + more, "R"))
    return product(INSERTED, own)


#: A rule of the grammar: the symbol, and the pair that it stands for.
Rules = list[tuple[str, str]]


def matrices(rules: Rules) -> dict[str, Matrix]:
    """A matrix for each symbol and, bottom-up, for each rule."""
    out = {c: symbol_matrix(*s) for c, s in SYMBOLS.items()}
    for name, pair in rules:
        joined = product(out[pair[0]], out[pair[1]])
        out[name] = joined
    return out


def compressed(sequence: str, rules: Rules) -> str:
    for name, pair in rules:
        if len(sequence) < 2:
            break
        sequence = sequence.replace(pair, name)
    return sequence


def re_pair(sequences: DataFrame) -> Rules:
    """Rules for pairs of symbols that recur in the rows (seq, n), n the times that a sequence occurs.

    Each round counts all pairs of neighbours under the rules so far and makes rules of the most frequent ones, skipping
    pairs that share a symbol with a better one, whose count this one would change. Counts are added up before they are
    shuffled; a round sends the driver a few pairs.
    """
    ship(sequences.sparkSession)
    rules: Rules = []

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[str] = Counter()
        for batch in batches:
            for s, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                s = compressed(s, rules)
                for i in range(len(s) - 1):
                    found[s[i : i + 2]] += n
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["pair", "n"])

    for _ in range(ROUNDS):
        best = sequences.select("seq", "n").mapInArrow(pairs, "pair string, n long").groupBy("pair").agg(F.sum("n").alias("n")).where("n > 1").orderBy(F.desc("n"), "pair").limit(8 * PICKS).collect()
        used: set[str] = set()
        picked = []
        for r in best:
            if not used & set(r["pair"]) and len(picked) < PICKS and len(rules) + len(picked) < RULES:
                picked.append(r["pair"])
                used |= set(r["pair"])
        if not picked:
            break
        rules = rules + [(chr(FIRST_RULE + len(rules) + i), p) for i, p in enumerate(picked)]
    return rules


class Path(NamedTuple):
    """A cheapest way from a conversation's start into a state: cost, and (chunk, state before, edits) not yet settled."""

    cost: int
    open: tuple


def spelled(path: Path) -> str:
    return "".join(p[2] for p in path.open)


def step(paths: dict[int, Path], head: int, m: Matrix) -> dict[int, Path]:
    """The paths after one more chunk; head names the chunk."""
    out: dict[int, Path] = {}
    for (s, t), way in m.items():
        if s in paths:
            new = Path(paths[s].cost + way.cost, (*paths[s].open, (head, s, letters(way.rope))))
            old = out.get(t)
            if old is None or new.cost < old.cost or (new.cost == old.cost and spelled(new) < spelled(old)):
                out[t] = new
    return out


def settle(paths: dict[int, Path]) -> tuple[dict[int, Path], list[tuple]]:
    """Takes the chunks that all paths agree on out of them."""
    done: list[tuple] = []
    while all(len(p.open) > 1 for p in paths.values()) and len({p.open[0] for p in paths.values()}) == 1:
        done.append(next(iter(paths.values())).open[0])
        paths = {t: Path(p.cost, p.open[1:]) for t, p in paths.items()}
    return paths, done


def finish(paths: dict[int, Path]) -> Path:
    """The best path into an end, with empty turns at the end where they are needed."""
    best = None
    for s, path in paths.items():
        for t in ENDS:
            if (s, t) in INSERTED:
                more = INSERTED[s, t]
                *front, (head, before, edits) = path.open
                new = Path(path.cost + more.cost, (*front, (head, before, edits + letters(more.rope))))
                if best is None or (new.cost, spelled(new)) < (best.cost, spelled(best)):
                    best = new
    return best


def written(state: int, edits: str, turns: list[tuple[str, str]]) -> list[str]:
    """The lines role:text that the edits leave of a chunk's turns."""
    out, rest = [], iter(turns)
    for e in edits:
        role, text = ("", "") if e == "I" else next(rest)
        if e == "D":
            continue
        kind = role[:1] if e == "K" else "a" if state == USER else "u"
        out.append(f"{role if e == 'K' else NAMES[kind]}:{text}")
        state = NEXT[state, kind]
    return out


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) after the damage that crc32 of conv_id and turn decides. Nulls are one space, but in turn's order."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), blank("role").alias("role"), blank("text").alias("text"), code.alias("code")).where("code <> 0")
    text = F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("code") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("code") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")


def placed(rows: DataFrame) -> DataFrame:
    """rows in the order of conversation and turn, with at, a number that rises in that order.

    Rows are dealt by ranges and numbered by partition and place, so that a conversation of any size spans as many
    partitions as it fills and its parts stay in order. Equal turns go by role and text, equal rows by the scan.
    """
    keys = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("h1"), F.col("h2"), F.col("scan")]
    hashed = rows.withColumn("h1", F.xxhash64("text")).withColumn("h2", F.xxhash64(F.lit(7), "text")).withColumn("scan", F.monotonically_increasing_id())
    return checkpoint(hashed.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("scan").withColumn("at", F.monotonically_increasing_id()))


def symbols(rows: DataFrame) -> DataFrame:
    """(conv_id, at, turn, initial, fault, symbol) of placed rows: the first fault of blank, duplicate and truncated."""
    earliest = rows.groupBy("conv_id", "role", "h1", "h2").agg(F.min("at").alias("first")).select("first")
    bare = F.rtrim(F.regexp_replace("text", GAPS, " "))
    facts = rows.select("conv_id", "at", "turn", F.left("role", F.lit(1)).alias("initial"), (bare == "").alias("blank"), (~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("cut"))
    met = facts.join(earliest, F.col("at") == F.col("first"), "left")
    fault = F.when(F.col("blank"), "blank").when(F.col("first").isNull(), "duplicate").when(F.col("cut"), "truncated").otherwise("none")
    named = met.select("conv_id", "at", "turn", "initial", fault.alias("fault"))
    i = F.when(F.col("initial").isin("s", "u", "a"), F.instr(F.lit(INITIALS), F.col("initial")) - 1).otherwise(3)
    j = F.when(F.col("fault") == "truncated", 2).when(F.col("fault") == "none", 0).otherwise(1)
    return named.withColumn("symbol", F.char(ord("A") + 3 * i + j))


def chunked(named: DataFrame) -> DataFrame:
    """(conv_id, head, seq and counts of a chunk): consecutive turns of a conversation that stand in one stretch of a partition."""
    chunk = F.shiftright("at", BITS)
    in_order = F.array_sort(F.collect_list(F.struct("at", "symbol", "initial")))
    count = lambda kind: F.count_if(F.col("fault") == kind).alias(kind)
    out = named.groupBy("conv_id", chunk.alias("chunk")).agg(F.min("at").alias("head"), in_order.alias("rows"), *[count(k) for k in ("blank", "duplicate", "truncated")])
    roles = F.transform("rows", lambda r: r["initial"])
    return out.select("conv_id", "head", F.array_join(F.transform("rows", lambda r: r["symbol"]), "").alias("seq"), roles.alias("roles"), "blank", "duplicate", "truncated")


def _dealt(df: DataFrame) -> DataFrame:
    """All rows of a conversation in one task, in order, one batch of them at a time."""
    return df.repartition("conv_id").sortWithinPartitions("conv_id", "head")


def settled(chunks: DataFrame, rules: Rules) -> DataFrame:
    """(conv_id, head, state, edits, cost, illegal): for each chunk the state it starts in and its edits; cost and illegal, the neighbours of roles that do not go together, stand at a conversation's last chunk."""
    known = matrices(rules)
    kind = chunks.schema["conv_id"].dataType.simpleString()

    def table(rows: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
        kinds = {"conv_id": id_type, "head": pa.int64(), "state": pa.int32(), "edits": pa.string(), "cost": pa.int64(), "illegal": pa.int64()}
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds.values())], names=list(kinds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Matrix] = {}
        out: list[tuple] = []
        conv, paths, illegal, last = object(), {}, 0, None

        def matrix_of(seq: str) -> Matrix:
            found = seen.get(seq)
            if found is None:
                short = compressed(seq, rules)
                found = known[short[0]]
                for c in short[1:]:
                    found = product(found, known[c])
                if len(seen) < 4096:
                    seen[seq] = found
            return found

        def close() -> None:
            if paths:
                best = finish(paths)
                out.extend((conv, h, s, e, None, None) for h, s, e in best.open[:-1])
                out.append((conv, *best.open[-1], best.cost, illegal))

        for batch in batches:
            id_type = batch.schema.field(0).type
            for c, head, seq, roles in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if not paths or c != conv:
                    close()
                    conv, paths, illegal, last = c, {EMPTY: Path(0, ())}, 0, None
                for role in roles:
                    illegal += last is not None and last + role not in ("su", "ua", "au")
                    last = role
                paths, done = settle(step(paths, head, matrix_of(seq)))
                out.extend((conv, h, s, e, None, None) for h, s, e in done)
            yield table(out, id_type)
            out.clear()
        close()
        if out:
            yield table(out, id_type)

    return _dealt(chunks.select("conv_id", "head", "seq", "roles")).mapInArrow(run, f"conv_id {kind}, head long, state int, edits string, cost long, illegal long")


def hashes(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256): chunks of turns with their edits, read in order into a hash that is fed line by line."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    lines = rows.groupBy("conv_id", F.shiftright("at", BITS).alias("chunk")).agg(F.min("at").alias("head"), F.array_sort(F.collect_list(F.struct("at", "role", "text"))).alias("turns"))
    own = edits.select(F.col("head").alias("h"), "state", "edits")
    met = lines.join(own, F.col("head") == F.col("h")).select("conv_id", "head", "state", "edits", F.transform("turns", lambda t: t["role"]).alias("roles"), F.transform("turns", lambda t: t["text"]).alias("texts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, digest, begun = None, None, False
        for batch in batches:
            ids, found = [], []
            id_type = batch.schema.field(0).type
            for row in range(batch.num_rows):
                c, _, state, edits, roles, texts = (batch.column(i)[row].as_py() for i in range(6))
                if digest is None or c != conv:
                    if digest is not None:
                        ids.append(conv)
                        found.append(digest.hexdigest())
                    conv, digest, begun = c, hashlib.sha256(), False
                for line in written(state, edits, list(zip(roles, texts, strict=True))):
                    digest.update((("\n" if begun else "") + line).encode())
                    begun = True
            yield pa.RecordBatch.from_arrays([pa.array(ids, id_type), pa.array(found, pa.string())], names=["conv_id", "repaired_sha256"])
        if digest is not None:
            yield pa.RecordBatch.from_arrays([pa.array([conv], id_type), pa.array([digest.hexdigest()], pa.string())], names=["conv_id", "repaired_sha256"])

    return _dealt(met).mapInArrow(run, f"conv_id {kind}, repaired_sha256 string")


def repaired(conversations: DataFrame, rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 of each conversation of the first table.

    rows (conv_id, turn, role, text) are the turns to repair, such as those that damaged gives. Rows of a conversation go
    by turn, missing turns first, equal ones by role and text; rows without conv_id are one conversation. Each row's first
    fault counts. A conversation without rows has zeros, an empty audit and the hash of the empty string. An empty table
    gives no rows; other columns are ignored.
    """
    ship(conversations.sparkSession)
    laid = placed(rows)
    named = symbols(laid)
    chunks = checkpoint(chunked(named))
    rules = re_pair(checkpoint(chunks.groupBy("seq").agg(F.count(F.lit(1)).alias("n"))))
    edits = checkpoint(settled(chunks, rules))
    turns = laid.groupBy("conv_id", "turn").agg(F.lit(0).alias("unused")).where("turn IS NOT NULL").groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.count(F.lit(1))).alias("gaps"))
    zero = lambda *names: [F.lit(0).cast("long").alias(n) for n in names]
    none = F.array().cast("array<struct<head:long,edits:string>>").alias("audits")
    text = F.lit(None).cast("string").alias("repaired_sha256")
    counts = ("blank", "duplicate", "truncated")
    parts = [
        conversations.select("conv_id").distinct().select("conv_id", *zero("gaps", *counts, "illegal", "cost"), none, text),
        turns.select("conv_id", "gaps", *zero(*counts, "illegal", "cost"), none, text),
        chunks.groupBy("conv_id").agg(*[F.sum(c).alias(c) for c in counts]).select("conv_id", *zero("gaps"), *counts, *zero("illegal", "cost"), none, text),
        edits.groupBy("conv_id").agg(F.max("cost").alias("cost"), F.max("illegal").alias("illegal"), F.array_sort(F.collect_list(F.struct("head", "edits"))).alias("audits")).select("conv_id", *zero("gaps", *counts), "illegal", "cost", "audits", text),
        hashes(laid, edits).select("conv_id", *zero("gaps", *counts, "illegal", "cost"), none, "repaired_sha256"),
    ]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    total = every.groupBy("conv_id").agg(*[F.sum(c).alias(c) for c in ("gaps", *counts, "illegal", "cost")], F.max("audits").alias("audits"), F.max("repaired_sha256").alias("repaired_sha256"))
    audit: Column = F.array_join(F.transform("audits", lambda a: a["edits"]), "")
    return total.select("conv_id", "gaps", *counts, "illegal", "cost", audit.alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
