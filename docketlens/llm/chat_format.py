"""Chat formatting with a repair of roles at least cost.

A legal conversation is an optional system turn, then user and assistant turns in alternation, and ends with the
assistant. Where a conversation is not legal, dynamic programming over the automaton of legal turns finds the cheapest
repair: a turn is kept, merged into the turn before it, given another role, or empty turns go in front of it.

The states after a turn are few, so what a run of turns does is a small matrix of costs (from each state, to each
state), and runs combine by the min-plus product. A long conversation is cut into chunks: their matrices are multiplied
in two levels, the states at the cuts follow from the products, and each chunk is then repaired on its own.
"""

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketlens.llm.common import bounded_broadcast, checkpoint, numbered, ship

#: States: what the conversation's last turn is.
STATES = ("start", "system", "user", "assistant")
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
#: Names of roles in use.
ROLES = {"system": SYSTEM, "developer": SYSTEM, "user": USER, "human": USER, "prompter": USER, "assistant": ASSISTANT, "bot": ASSISTANT, "gpt": ASSISTANT, "model": ASSISTANT}
#: Costs of the repairs. A turn whose role is unknown or missing is cheap to name.
MERGE, RELABEL, NAME, INSERT = 1, 3, 1, 2
NEVER = 1 << 60
#: Distinct turns in a chunk, and chunks in a block.
CHUNK, BLOCK = 256, 256
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def role_of(name: str | None) -> int | None:
    return ROLES.get(name.strip().lower()) if name else None


def reach() -> list[dict[int, tuple[int, ...]]]:
    """For each state, the states that empty turns lead to, with those turns."""
    found = []
    for state in range(4):
        ways: dict[int, tuple[int, ...]] = {state: ()}
        queue = [state]
        for s in queue:
            for t in NEXT[s]:
                if t not in ways:
                    ways[t] = (*ways[s], t)
                    queue.append(t)
        found.append(ways)
    return found


WAYS = reach()


def steps(role: int | None) -> list[list[tuple[int, str, tuple[int, ...]]]]:
    """steps[s][t]: the cheapest (cost, action, empty turns before) that takes a turn of this role from s to t."""
    table = [[(NEVER, "", ()) for _ in range(4)] for _ in range(4)]
    for s in range(4):
        for t in (SYSTEM, USER, ASSISTANT):
            label = 0 if t == role else NAME if role is None else RELABEL
            options = [(MERGE + label, "merge" if t == role else "merge_relabel", ())] if s == t else []
            for between, empty in WAYS[s].items():
                if t in NEXT[between]:
                    options.append((INSERT * len(empty) + label, "keep" if t == role else "relabel", empty))
            table[s][t] = min(options, key=lambda o: (o[0], len(o[2]), o[1]), default=table[s][t])
    return table


STEPS = {role: steps(role) for role in (None, SYSTEM, USER, ASSISTANT)}
UNIT = [[0 if s == t else NEVER for t in range(4)] for s in range(4)]


def product(a: list[list[int]], b: list[list[int]]) -> list[list[int]]:
    return [[min(NEVER, min(a[s][k] + b[k][t] for k in range(4))) for t in range(4)] for s in range(4)]


def matrix(roles: list[int | None]) -> list[list[int]]:
    out = UNIT
    for role in roles:
        out = product(out, [[STEPS[role][s][t][0] for t in range(4)] for s in range(4)])
    return out


def ending(state: int) -> tuple[int, tuple[int, ...]]:
    """Cost and empty turns that end a conversation legally."""
    empty = WAYS[state][ASSISTANT]
    return INSERT * len(empty), empty


def path(matrices: list[list[list[int]]], enter: int, leave: int | None) -> list[int]:
    """States at the cuts, enter first, on the cheapest way; leave None: wherever ending is cheapest."""
    costs = [[0 if s == enter else NEVER for s in range(4)]]
    for m in matrices:
        costs.append([min(NEVER, min(costs[-1][s] + m[s][t] for s in range(4))) for t in range(4)])
    at = min(range(4), key=lambda t: (costs[-1][t] + ending(t)[0], t)) if leave is None else leave
    states = [at]
    for i in range(len(matrices) - 1, -1, -1):
        at = min(range(4), key=lambda s: (costs[i][s] + matrices[i][s][at], s))
        states.append(at)
    return states[::-1]


def repair(turns: list[tuple[str | None, str | None]], enter: int, leave: int | None, last: bool) -> list[dict]:
    """For each (role, text): what becomes of it, and its piece of the rendered conversation."""
    roles = [role_of(r) for r, _ in turns]
    states = path([[[STEPS[r][s][t][0] for t in range(4)] for s in range(4)] for r in roles], enter, leave)
    out = []
    for i, (_, text) in enumerate(turns):
        s, t = states[i], states[i + 1]
        cost, action, empty = STEPS[roles[i]][s][t]
        body = (text or "").replace("<|im_", "<| im_")
        if action.startswith("merge"):
            piece = "\n\n" + body
        else:
            piece = (CLOSE if s != START else "") + "".join(f"{OPEN}{STATES[e]}\n{CLOSE}" for e in empty) + f"{OPEN}{STATES[t]}\n{body}"
        closing: tuple[int, ...] = ()
        if last and i == len(turns) - 1:
            more, closing = ending(t)
            cost += more
            piece += CLOSE + "".join(f"{OPEN}{STATES[e]}\n{CLOSE}" for e in closing)
        out.append({"new_role": STATES[t], "action": action, "inserted": [STATES[e] for e in empty], "closing": [STATES[e] for e in closing], "cost": cost, "rendered": piece})
    return out


def _as_matrix(flat) -> list[list[int]]:
    return [[int(flat[4 * s + t]) for t in range(4)] for s in range(4)]


def _cut_states(turns: DataFrame) -> DataFrame:
    """(c, k, enter, leave, last) for the chunks of conversations that have several."""
    several = turns.groupBy("conv_id").agg(F.min("chunk").alias("a"), F.max("chunk").alias("b")).where("a <> b").select(F.col("conv_id").alias("c"))
    mine = turns.join(bounded_broadcast(checkpoint(several)), F.col("conv_id").eqNullSafe(F.col("c"))).select("c", "chunk", F.floor(F.col("chunk") / BLOCK).alias("block"), "turn", "hash", "role")
    flat = "c {0}, block long, chunk long, m array<long>".format(turns.schema["conv_id"].dataType.simpleString())

    def of_chunk(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["turn", "hash"], na_position="last")
        m = matrix([role_of(r) for r in g["role"]])
        return pd.DataFrame({"c": [g["c"].iloc[0]], "block": [g["block"].iloc[0]], "chunk": [g["chunk"].iloc[0]], "m": [[x for row in m for x in row]]})

    def of_block(g: pd.DataFrame) -> pd.DataFrame:
        out = UNIT
        for m in g.sort_values("chunk")["m"]:
            out = product(out, _as_matrix(m))
        return pd.DataFrame({"c": [g["c"].iloc[0]], "block": [g["block"].iloc[0]], "chunk": [-1], "m": [[x for row in out for x in row]]})

    chunks = checkpoint(mine.groupBy("c", "block", "chunk").applyInPandas(of_chunk, flat))
    blocks = chunks.groupBy("c", "block").applyInPandas(of_block, flat)

    def block_states(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("block")
        states = path([_as_matrix(m) for m in g["m"]], START, None)
        return pd.DataFrame({"c2": g["c"], "block2": g["block"], "enter": states[:-1], "leave": states[1:], "last": [False] * (len(g) - 1) + [True]})

    kind = turns.schema["conv_id"].dataType.simpleString()
    ends = blocks.groupBy("c").applyInPandas(block_states, f"c2 {kind}, block2 long, enter int, leave int, last boolean")

    def chunk_states(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("chunk")
        states = path([_as_matrix(m) for m in g["m"]], int(g["enter"].iloc[0]), int(g["leave"].iloc[0]))
        last = [False] * (len(g) - 1) + [bool(g["last"].iloc[0])]
        return pd.DataFrame({"c": g["c"], "k": g["chunk"], "enter": states[:-1], "leave": states[1:], "last": last})

    inside = chunks.join(ends, F.col("c").eqNullSafe(F.col("c2")) & (F.col("block") == F.col("block2"))).drop("c2", "block2")
    return checkpoint(inside.groupBy("c", "block").applyInPandas(chunk_states, f"c {kind}, k long, enter int, leave int, last boolean"))


def _in_chunks(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """turns with their chunk, and the distinct (conv_id, chunk, turn, hash, role) of conversations of many rows.

    A conversation of up to CHUNK rows is one chunk. Of the others repeated rows go, which combines before the shuffle,
    and chunks are CHUNK places in the order of all distinct turns.
    """
    hot = bounded_broadcast(checkpoint(turns.groupBy("conv_id").count().where(F.col("count") > CHUNK).select(F.col("conv_id").alias("h"), F.lit(True).alias("many"))))
    marked = turns.join(hot, F.col("conv_id").eqNullSafe(F.col("h")) & F.col("many"), "left").drop("h")
    few = marked.where("many IS NULL").drop("many").withColumn("chunk", F.lit(0).cast("long"))
    many = marked.where("many").drop("many").distinct()
    placed = numbered(many.select("conv_id", "turn", "hash", "role").distinct(), "conv_id", "turn", "hash", "role")
    starts = placed.groupBy(F.col("conv_id").alias("h")).agg(F.min("row_number").alias("start"))
    placed = placed.join(bounded_broadcast(starts), F.col("conv_id").eqNullSafe(F.col("h")))
    keys = checkpoint(placed.select("conv_id", F.floor((F.col("row_number") - F.col("start")) / CHUNK).cast("long").alias("chunk"), "turn", "hash", "role"))
    own = keys.select(*[F.col(c).alias(f"k_{c}") for c in ("conv_id", "turn", "hash", "role")], "chunk")
    same = [F.col(c).eqNullSafe(F.col(f"k_{c}")) for c in ("conv_id", "turn", "hash", "role")]
    split = many.join(own, same[0] & same[1] & same[2] & same[3]).select(*few.columns)
    return few.unionByName(split), keys


def format_chats(conversations: DataFrame) -> DataFrame:
    """One row per turn: conv_id, turn, role, new_role, action, inserted, closing, cost, rendered.

    The rendered pieces of a conversation, in the order of turn, hash and role, are the whole repaired conversation;
    inserted are the roles of empty turns before a turn, closing of those after the last one. Turns go by number,
    missing numbers last, equal numbers by the hash of role and text. Repeated rows are one turn. A missing or unknown
    role is named at small cost; a null text is empty. Rows without conv_id make up one conversation. An empty table
    gives an empty result. Text is shuffled once, that of conversations of
    more than CHUNK rows a second time; a conversation of any length, its turns numbered or not, is at most one
    chunk of distinct rows in memory.
    """
    ship(conversations.sparkSession)
    turn = F.col("turn").cast("long")
    turns = conversations.select("conv_id", turn.alias("turn"), "role", "text", F.xxhash64("role", F.lit("/"), "text").alias("hash"))
    turns, keys = _in_chunks(turns)
    cuts = bounded_broadcast(_cut_states(keys))
    laid = turns.join(cuts, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("chunk") == F.col("k")), "left").drop("c", "k")
    order = ["conv_id", "chunk", F.col("turn").asc_nulls_last(), "hash", F.col("role").asc_nulls_last()]
    dealt = laid.repartition("conv_id", "chunk").sortWithinPartitions(*order)
    names = ["conv_id", "turn", "role", "new_role", "action", "inserted", "closing", "cost", "rendered"]
    kinds = [pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string()), pa.int64(), pa.string()]
    kind = conversations.schema["conv_id"].dataType.simpleString()

    def write(group: list[dict]) -> pa.RecordBatch:
        unique = list({(r["turn"], r["hash"], r["role"], r["text"]): r for r in group}.values())
        first = unique[0]
        known = first["enter"] is not None
        out = repair([(r["role"], r["text"]) for r in unique], first["enter"] if known else START, first["leave"] if known and not first["last"] else None, not known or first["last"])
        own = [pa.array([r[k] for r in unique], t) for k, t in (("conv_id", id_type[0]), ("turn", pa.int64()), ("role", pa.string()))]
        return pa.RecordBatch.from_arrays([*own, *[pa.array([o[k] for o in out], t) for k, t in zip(names[3:], kinds, strict=True)]], names=names)

    id_type: list[pa.DataType] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[dict] = []
        for batch in batches:
            id_type[:] = [batch.schema.field("conv_id").type]
            for row in batch.to_pylist():
                if group and (row["conv_id"], row["chunk"]) != (group[0]["conv_id"], group[0]["chunk"]):
                    yield write(group)
                    group = []
                group.append(row)
        if group:
            yield write(group)

    schema = f"conv_id {kind}, turn long, role string, new_role string, action string, inserted array<string>, closing array<string>, cost long, rendered string"
    return dealt.mapInArrow(run, schema)
