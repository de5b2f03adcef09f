"""Exact Jaccard self-join of documents on their word n-grams by a prefix tree.

1. Every text becomes the sorted set of the 64-bit hashes of its n-grams. Equal sets are one node from here on.
2. Search. Under any global order of the n-grams, two sets of likeness t share at least m n-grams among their first
   n - ceil(t n) + m each. The order by hash needs no statistics: those leading n-grams of all documents meet by
   hash, and a node that shares fewer than m of them with others can have no partner. This leaves copies and few others.
3. The n-grams of what is left are counted, and put in order from rare to frequent. What only one node has counts as a
   mismatch at once; rare shared n-grams among the leading ones tie nodes into neighbourhoods. No link crosses them.
4. In a neighbourhood, sets are stored in a prefix tree with the frequent n-grams first, so that near copies share long
   paths and the overlap along them is counted once. A set walks down with its partial overlap and leaves a subtree
   where the lengths that remain cannot reach the likeness. Nodes that are already connected are not compared again.
5. A neighbourhood of more n-grams than a task should hold is dealt in chunks, and what a chunk links is one label from
   there on. A few sets of each label are then compared across chunks, and again while that halves the labels, so that
   near copies of one text come down to one label. At last the sets outside the neighbourhood's largest label meet
   all sets of other labels, block by chunk. So no pair goes unseen, and the work grows with the neighbourhood's size
   times the sets outside its largest label, not with the square of its size. Links meet in connected components.
"""

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketlens.llm.common import WORD, bounded_broadcast, checkpoint, ship
from docketlens.llm.components import components

#: Extra leading n-grams of the search, in percent of a set, which must be shared beyond the first.
EXTRA = 15
#: Postings that a search task gathers, about.
POSTINGS = 1_500_000
#: N-grams that a comparing task holds of each side, about.
GRAMS = 1_000_000
#: Sets of a label that are compared across chunks.
SAMPLES = 4
#: A node of more documents than this, and than this share of all, has its result broadcast: there are few of them.
HOT_DOCS, HOT_SHARE = 1_000, 0.0001

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


def least_overlap(n: int, percent: int) -> int:
    """What a set of n must share with any partner."""
    return -(-percent * n // 100)


def ngram_set(text: str | None, words: int = 5) -> np.ndarray:
    """Sorted distinct hashes of a text's n-grams; of the whole sequence where it is shorter; empty without words."""
    parts = text.encode("utf-8").lower().split() if text else []
    if not parts:
        return np.empty(0, np.int64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, parts), np.uint64, len(parts))
    size = min(words, len(h))
    weights = np.resize(_ODD, size) + np.arange(size, dtype=np.uint64) // np.uint64(len(_ODD)) * np.uint64(2)
    total = np.full(len(h) - size + 1, 0 if size == words else size, np.uint64)
    for i in range(size):
        total += h[i : len(h) - size + 1 + i] * weights[i]
    total = (total ^ (total >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    total = (total ^ (total >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return np.unique((total ^ (total >> np.uint64(31))).view(np.int64))


def node_of(grams: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(grams.tobytes())


def node_number(node: bytes) -> int:
    """64 bits of a node for the search; 0 is kept for n-grams that a batch has more than once."""
    return int.from_bytes(node[:8], "little", signed=True) or 1


def document_sets(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, text_key, n, node, number): set sizes and identities; node is null for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [ngram_set(t, words) for t in batch.column("text").to_pylist()]
            nodes = [node_of(s) if len(s) else None for s in sets]
            columns = [pa.array([len(s) for s in sets], pa.int64()), pa.array(nodes, pa.binary()), pa.array([x and node_number(x) for x in nodes], pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), *columns], names=["doc_id", "text_key", "n", "node", "number"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_key")).mapInArrow(run, f"doc_id {kind}, text_key long, n long, node binary, number long")


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For sorted values: where each run starts, and the run of each place."""
    first = np.ones(len(values), bool)
    first[1:] = values[1:] != values[:-1]
    return np.flatnonzero(first), np.cumsum(first) - 1


def _summed(numbers: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct numbers with the sums of their counts."""
    number, count = np.concatenate([np.empty(0, np.int64), *numbers]), np.concatenate([np.empty(0, np.int64), *counts])
    order = np.argsort(number, kind="stable")
    starts, _ = _runs(number[order])
    return number[order][starts], np.add.reduceat(count[order], starts) if len(starts) else count


def likely_nodes(docs: DataFrame, sets: DataFrame, words: int, percent: int) -> DataFrame:
    """Numbers of the nodes that share enough of their leading n-grams with other nodes (step 2).

    A map task sends an n-gram that several nodes of a batch share as one row, so that an n-gram of a third of all
    documents is a row a batch. Postings go by hash to as many tasks as their number needs. Within a task 32 more bits
    tell n-grams apart; two that meet by chance look shared, which keeps a node too many and never loses one.
    """
    total = sets.agg(F.sum("n")).first()[0] or 0
    lead = (100 - percent + EXTRA) / 100
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(total * lead / POSTINGS))

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leading: dict[int, np.ndarray] = {}
            for text in batch.column("text").to_pylist():
                grams = ngram_set(text, words)
                if n := len(grams):
                    leading[node_number(node_of(grams))] = grams[: n - least_overlap(n, percent) + 1 + EXTRA * n // 100]
            if not leading:
                continue
            grams = np.concatenate(list(leading.values()))
            owner = np.repeat(np.fromiter(leading, np.int64, len(leading)), [len(x) for x in leading.values()])
            order = np.argsort(grams, kind="stable")
            grams, owner = grams[order], owner[order]
            starts, run = _runs(grams)
            many = np.diff(np.append(starts, len(grams))) > 1
            met = owner[many[run]]
            grams, owner = grams[starts], np.where(many, 0, owner[starts])
            bucket, short = grams.view(np.uint64) % np.uint64(tasks), (grams.view(np.uint64) // np.uint64(tasks)).astype(np.uint32)
            order = np.argsort(bucket, kind="stable")
            cuts, _ = _runs(bucket[order])
            groups = np.split(order, cuts[1:])
            who, count = np.unique(met, return_counts=True)
            rows = [(int(bucket[g[0]]), short[g].tobytes(), owner[g].tobytes(), b"", b"") for g in groups]
            rows.append((int(who[0]) % tasks if len(who) else 0, b"", b"", who.tobytes(), count.astype(np.int64).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int32(), *[pa.binary()] * 4), strict=True)], names=["bucket", "grams", "owner", "who", "count"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, owner, whom, counts = [], [], [], []
        for batch in batches:
            for g, o, w, c in zip(*(batch.column(k).to_pylist() for k in ("grams", "owner", "who", "count")), strict=True):
                grams.append(np.frombuffer(g, np.uint32))
                for to, data in ((owner, o), (whom, w), (counts, c)):
                    to.append(np.frombuffer(data, np.int64))
        if not grams:
            return
        g, o = np.concatenate(grams), np.concatenate(owner)
        order = np.lexsort((o, g))
        g, o = g[order], o[order]
        new = np.ones(len(g), bool)
        new[1:] = (g[1:] != g[:-1]) | (o[1:] != o[:-1])
        g, o = g[new], o[new]
        starts, run = _runs(g)
        length = np.diff(np.append(starts, len(g)))
        met = np.zeros(len(starts), bool)
        np.logical_or.at(met, run[o == 0], True)
        here = o[((length > 1) | met)[run] & (o != 0)]
        who, count = _summed([*whom, here], [*counts, np.ones(len(here), np.int64)])
        # One packed row for each task that sums, so that the number of rows does not grow with the tasks of both sides.
        bucket = who.view(np.uint64) % np.uint64(tasks)
        order = np.argsort(bucket, kind="stable")
        cuts, _ = _runs(bucket[order])
        groups = np.split(order, cuts[1:]) if len(order) else []
        rows = [(int(bucket[i[0]]), who[i].tobytes(), count[i].tobytes()) for i in groups]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["bucket", "who", "count"])

    def total_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whom, counts = [], []
        for batch in batches:
            whom += [np.frombuffer(x, np.int64) for x in batch.column("who").to_pylist()]
            counts += [np.frombuffer(x, np.int64) for x in batch.column("count").to_pylist()]
        who, count = _summed(whom, counts)
        yield pa.RecordBatch.from_arrays([pa.array(who, pa.int64()), pa.array(count, pa.int64())], names=["number", "shared"])

    posted = docs.select("text").mapInArrow(post, "bucket int, grams binary, owner binary, who binary, count binary")
    packed = posted.repartition(tasks, "bucket").mapInArrow(meet, "bucket int, who binary, count binary")
    shared = packed.repartition(tasks, "bucket").mapInArrow(total_of, "number long, shared long")
    known = sets.where("number IS NOT NULL").select("number", F.lit(0).cast("long").alias("shared"), "n")
    need = 1 + F.floor(EXTRA * F.ceil(F.col("n") * percent / 100) / 100)
    return shared.withColumn("n", F.lit(0).cast("long")).union(known).groupBy("number").agg(F.sum("shared").alias("shared"), F.max("n").alias("n")).where(F.col("shared") >= need).select("number")


def ordered_sets(docs: DataFrame, sets: DataFrame, likely: DataFrame, words: int, percent: int) -> DataFrame:
    """(v, node, n, lead, grams): shared n-grams of likely nodes from rare to frequent; lead of them are leading (step 3)."""
    kept = sets.join(bounded_broadcast(checkpoint(likely)), "number").groupBy("node").agg(F.min("text_key").alias("wanted"))
    chosen = docs.select("text", F.xxhash64("text").alias("text_key")).join(bounded_broadcast(checkpoint(kept.select("wanted"))), F.col("text_key") == F.col("wanted"), "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(at, 500) for at in range(0, batch.num_rows, 500)):
                found: dict[bytes, np.ndarray] = {}
                for text in part.column("text").to_pylist():
                    grams = ngram_set(text, words)
                    if len(grams):
                        found[node_of(grams)] = grams
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array([g.tobytes() for g in found.values()], pa.binary())], names=["node", "blob"])

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v, blobs = batch.column("v").to_numpy(), [np.frombuffer(b, np.int64) for b in batch.column("blob").to_pylist()]
            for at in range(0, len(v), 500):
                part = blobs[at : at + 500]
                sizes = [len(b) for b in part]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(v[at : at + 500], sizes)), pa.array(np.concatenate(part))], names=["v", "gram"])

    own = chosen.select("text").mapInArrow(run, "node binary, blob binary").dropDuplicates(["node"])
    stored = checkpoint(own.withColumn("v", F.monotonically_increasing_id()))
    grams = stored.select("v", "blob").mapInArrow(unpack, "v long, gram long")
    counts = grams.groupBy(F.col("gram").alias("g")).agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    shared = grams.join(counts, F.col("gram") == F.col("g")).groupBy("v").agg(F.array_sort(F.collect_list(F.struct("df", "gram"))).alias("s"))
    shared = shared.join(stored.select(F.col("v").alias("w"), "node", F.floor(F.octet_length("blob") / 8).alias("n")), F.col("v") == F.col("w"))
    lead = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1 - (F.col("n") - F.size("s"))
    return checkpoint(shared.select("v", "node", "n", lead.cast("int").alias("lead"), F.transform("s", lambda x: x["gram"]).alias("grams")).where("lead > 0"))


class Branch:
    """A run of n-grams in the prefix tree, the sets that end with it, and the bounds of what lies below."""

    __slots__ = ("grams", "below", "ends", "rest", "least", "most")

    def __init__(self, grams: list[int], rest: int, least: int, most: int):
        self.grams, self.rest, self.least, self.most = grams, rest, least, most
        self.below: dict[int, Branch] = {}
        self.ends: list[int] = []


class PrefixTree:
    """Sets of n-grams in one order; rest counts the longest way down from a branch's start."""

    def __init__(self):
        self.top = Branch([], 0, 1 << 62, 0)

    def add(self, item: int, size: int, grams: list[int]) -> None:
        at, branch = 0, self.top
        while True:
            branch.rest = max(branch.rest, len(grams) - at)
            branch.least, branch.most = min(branch.least, size), max(branch.most, size)
            same = 0
            for a, b in zip(branch.grams, grams[at : at + len(branch.grams)], strict=False):
                if a != b:
                    break
                same += 1
            if same < len(branch.grams):  # split: the tail moves one branch down
                tail = Branch(branch.grams[same:], branch.rest - same, branch.least, branch.most)
                tail.below, tail.ends = branch.below, branch.ends
                branch.below, branch.ends, branch.grams = {tail.grams[0]: tail}, [], branch.grams[:same]
            at += same
            if at == len(grams):
                branch.ends.append(item)
                return
            if grams[at] not in branch.below:
                branch.below[grams[at]] = leaf = Branch(grams[at:], len(grams) - at, size, size)
                leaf.ends.append(item)
                return
            branch = branch.below[grams[at]]

    def search(self, size: int, grams: list[int], percent: int, joined) -> Iterator[tuple[int, int]]:
        """(item, overlap) of sets that may reach the likeness; joined(items) says that these need no comparison."""
        own, stack = set(grams), [(self.top, 0)]
        while stack:
            branch, overlap = stack.pop()
            if 100 * branch.most < percent * size or not branch.below and joined(branch.ends):
                continue
            need = -(-percent * (size + branch.least) // (100 + percent))
            if overlap + min(len(own) - overlap, branch.rest) < need:
                continue
            overlap += len(own.intersection(branch.grams))
            if overlap + min(len(own) - overlap, branch.rest - len(branch.grams)) < need:
                continue
            for item in branch.ends:
                yield item, overlap
            stack += [(b, overlap) for b in branch.below.values()]


def join_sets(sets: list[tuple[int, int, list[int]]], percent: int) -> list[int]:
    """For (v, size, grams from frequent to rare): the smallest v that each set is connected with."""
    root = list(range(len(sets)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    tree = PrefixTree()
    for i in sorted(range(len(sets)), key=lambda i: sets[i][1]):
        _, size, grams = sets[i]
        for j, overlap in tree.search(size, grams, percent, lambda items, i=i: all(find(j) == find(i) for j in items)):
            if 100 * overlap >= percent * (size + sets[j][1] - overlap):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
        tree.add(i, size, grams)
    lowest: dict[int, int] = {}
    for i, (v, _, _) in enumerate(sets):
        lowest[find(i)] = min(v, lowest.get(find(i), v))
    return [lowest[find(i)] for i in range(len(sets))]


def join_across(stored: list[tuple[int, int, list[int], int]], asking: list[tuple[int, int, list[int], int]], percent: int) -> list[tuple[int, int]]:
    """For sets (v, size, grams from frequent to rare, label): links (v, v) that join all labels which links between the two lists join."""
    root: dict[int, int] = {}

    def find(label: int) -> int:
        while (up := root.get(label, label)) != label:
            root[label] = root.get(up, up)
            label = up
        return label

    tree, found = PrefixTree(), []
    for i, (_, size, grams, _) in enumerate(stored):
        tree.add(i, size, grams)
    for v, size, grams, label in asking:
        for j, overlap in tree.search(size, grams, percent, lambda items, label=label: all(find(stored[j][3]) == find(label) for j in items)):
            if find(stored[j][3]) != find(label) and 100 * overlap >= percent * (size + stored[j][1] - overlap):
                root[find(label)] = find(stored[j][3])
                found.append((v, stored[j][0]))
    return found


def _parts(load: Column) -> Column:
    return F.ceil(load / GRAMS).cast("int")


def _compared(ordered: DataFrame, placed: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) among the nodes w of placed that agree in area and part."""

    def kernel(group: pd.DataFrame) -> pd.DataFrame:
        sets = [(v, n, g[::-1].tolist()) for v, n, g in zip(group["v"].tolist(), group["n"].tolist(), group["grams"], strict=True)]
        return pd.DataFrame({"a": group["v"], "b": join_sets(sets, percent)})

    work = ordered.join(bounded_broadcast(placed.select("w", "area", "part")), F.col("v") == F.col("w")).select("v", "n", "grams", "area", "part")
    return checkpoint(work.groupBy("area", "part").applyInPandas(kernel, "a long, b long").where("a <> b"))


def _labelled(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """nodes (w, area, load) with the label that links give them, their own number where they have none."""
    roots = components(links)
    return checkpoint(nodes.join(bounded_broadcast(roots), F.col("w") == F.col("v"), "left").select("w", "area", "load", F.coalesce("root", "w").alias("label")))


def _across_labels(ordered: DataFrame, nodes: DataFrame, links: DataFrame, percent: int) -> DataFrame:
    """The links that are missing between the labels of large neighbourhoods (step 5), with those given."""
    labelled, before, rounds = _labelled(nodes, links), None, 0
    while True:
        count = labelled.select("area", "label").distinct().count()
        if before is not None and 2 * count > before or count == nodes.select("area").distinct().count():
            break
        before, rounds = count, rounds + 1
        some = [F.min_by("w", F.xxhash64("w", F.lit(rounds * SAMPLES + i))) for i in range(SAMPLES)]
        samples = labelled.groupBy("area", "label").agg(F.array_distinct(F.array(*some)).alias("ws")).select("area", F.explode("ws").alias("s"))
        samples = checkpoint(samples.join(nodes.select("w", "load"), F.col("s") == F.col("w")).select("area", "w", "load"))
        parts = bounded_broadcast(samples.groupBy(F.col("area").alias("of")).agg(_parts(F.sum("load")).alias("parts")))
        placed = samples.join(parts, F.col("area") == F.col("of")).withColumn("part", F.pmod(F.xxhash64("w", F.lit(rounds)), F.col("parts")))
        links = checkpoint(links.union(_compared(ordered, placed, percent)))
        labelled = _labelled(nodes, links)
    loads = labelled.groupBy("area", "label").agg(F.sum("load").alias("load"))
    largest = loads.groupBy(F.col("area").alias("of")).agg(F.max_by("label", F.struct("load", "label")).alias("largest"), _parts(F.sum("load")).alias("chunks"), F.sum("load").alias("all"), F.max("load").alias("top"))
    largest = bounded_broadcast(checkpoint(largest.where("all > top").withColumn("blocks", _parts(F.col("all") - F.col("top")))))
    open_ = labelled.join(largest, F.col("area") == F.col("of"))
    block, chunk = F.pmod(F.xxhash64("w", F.lit("block")), F.col("blocks")), F.pmod(F.xxhash64("w", F.lit("chunk")), F.col("chunks"))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    stored = open_.where("label <> largest").select("w", "area", "label", block.cast("int").alias("block"), each("chunks").alias("chunk"), F.lit(True).alias("stored"))
    asking = open_.select("w", "area", "label", each("blocks").alias("block"), chunk.cast("int").alias("chunk"), F.lit(False).alias("stored"))

    def kernel(group: pd.DataFrame) -> pd.DataFrame:
        rows = list(zip(group["v"].tolist(), group["n"].tolist(), [g[::-1].tolist() for g in group["grams"]], group["label"].tolist(), strict=True))
        kept = group["stored"].tolist()
        pairs = join_across([r for r, k in zip(rows, kept, strict=True) if k], [r for r, k in zip(rows, kept, strict=True) if not k], percent)
        return pd.DataFrame(pairs, columns=["a", "b"], dtype="int64")

    work = ordered.join(stored.union(asking), F.col("v") == F.col("w")).select("v", "n", "grams", "area", "label", "block", "chunk", "stored")
    return checkpoint(links.union(work.groupBy("area", "block", "chunk").applyInPandas(kernel, "a long, b long")))


def link_nodes(ordered: DataFrame, percent: int) -> DataFrame:
    """(v, root) of the nodes that have a partner (steps 4 and 5)."""
    leading = ordered.select("v", F.explode(F.slice("grams", F.lit(1), F.col("lead"))).alias("gram"))
    hubs = leading.groupBy(F.col("gram").alias("g")).agg(F.min("v").alias("hub"), F.max("v").alias("top")).where("hub <> top").select("g", "hub")
    near = components(leading.join(hubs, F.col("gram") == F.col("g")).select(F.col("v").alias("a"), F.col("hub").alias("b")).where("a <> b").distinct())
    near = checkpoint(near.select(F.col("v").alias("w"), F.col("root").alias("area")))
    loads = ordered.select("v", F.size("grams").cast("long").alias("load"))
    nodes = checkpoint(loads.join(bounded_broadcast(near), F.col("v") == F.col("w")).select("w", "area", "load"))
    sizes = bounded_broadcast(checkpoint(nodes.groupBy(F.col("area").alias("of")).agg(_parts(F.sum("load")).alias("parts")).where("parts > 1")))
    placed = nodes.join(sizes, F.col("area") == F.col("of"), "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("w"), F.col("parts")), F.lit(0)))
    links = _compared(ordered, placed, percent)
    large = checkpoint(placed.where("parts > 1").select("w", "area", "load"))
    if not large.isEmpty():
        inside = links.join(bounded_broadcast(large.select("w")), F.col("a") == F.col("w"), "left_semi")
        links = links.union(_across_labels(ordered, large, checkpoint(inside), percent))
    return components(links)


def _found(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """(doc_id, text_key, n, component_id, class): class is the smallest node of the component, null for an empty set."""
    ship(docs.sparkSession)
    sets = checkpoint(document_sets(docs, words))
    likely = likely_nodes(docs, sets, words, percent)
    ordered = ordered_sets(docs, sets, likely, words, percent)
    roots = link_nodes(ordered, percent)
    firsts = sets.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies"))
    linked = roots.join(ordered.select(F.col("v").alias("w"), F.col("node").alias("of")), F.col("v") == F.col("w")).select("of", "root")
    linked = checkpoint(linked.join(firsts, F.col("of") == F.col("node")).select("of", "root", "first"))
    joined = linked.groupBy(F.col("root").alias("r")).agg(F.min("first").alias("smallest"), F.min("of").alias("least"))
    by_node = linked.join(joined, F.col("root") == F.col("r")).select("of", "smallest", "least")
    identity = firsts.join(by_node, F.col("node") == F.col("of"), "left").select(F.col("node").alias("its"), F.coalesce("smallest", "first").alias("named"), F.coalesce("least", "node").alias("class"), "copies")
    # Copies of one node are as many rows of one key. The nodes that a share of all documents have are few, and are broadcast.
    hot = checkpoint(identity.where(F.col("copies") > F.greatest(F.lit(HOT_DOCS), F.lit(HOT_SHARE) * sets.count())).drop("copies"))
    marked = sets.join(F.broadcast(hot.withColumn("hot", F.lit(True))), F.col("node") == F.col("its"), "left")
    others = marked.where("hot IS NULL").select("doc_id", "text_key", "n", "node").join(identity.drop("copies"), F.col("node") == F.col("its"), "left")
    out = marked.where("hot").select("doc_id", "text_key", "n", "node", "its", "named", "class").union(others)
    return out.select("doc_id", "text_key", "n", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("named")).alias("component_id"), "class")


def ngram_components(docs: DataFrame, words: int = 5, percent: int = 75) -> DataFrame:
    """One row per document: doc_id, n_shingles and component_id, the smallest doc_id reachable over links.

    Two documents link when 100 * overlap >= percent * union of their n-gram sets. A null or blank text has an empty
    set and is its own component. Documents with equal sets are linked; a null doc_id is no one's smallest one unless
    a component has no other. Repeated rows stay. An empty table gives an empty result.
    """
    return _found(docs, words, percent).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def keep_one(docs: DataFrame, words: int = 5, percent: int = 75) -> DataFrame:
    """docs with one document of each component: the one with the smallest doc_id, null last. All columns stay.

    Of rows that agree in doc_id and text one stays. Documents with an empty set are no copies of each other and stay.
    """
    names = docs.columns
    found = _found(docs, words, percent).where("class IS NOT NULL")
    first = F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id").alias("d"), F.col("text_key").alias("k")))
    keep = found.groupBy("class").agg(first.alias("first")).select("first.d", "first.k")
    rows = docs.select(F.struct(*[docs[c] for c in names]).alias("row"), F.col("doc_id").alias("x"), F.xxhash64("text").alias("y"), F.coalesce("text", F.lit("")).rlike(WORD).alias("filled"))
    full = rows.where("filled").join(keep, F.col("x").eqNullSafe(F.col("d")) & (F.col("y") == F.col("k")), "left_semi").dropDuplicates(["x", "y"])
    return full.select("row").union(rows.where("NOT filled").select("row")).select(*[F.col(f"row.`{c}`").alias(c) for c in names])
