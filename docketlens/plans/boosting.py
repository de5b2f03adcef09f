"""Boosted trees with the pinball loss, for several quantiles at once, by aggregates over binned features.

Features are cut into bins once. For a tree, one aggregate counts rows, and those above their score, by all their bins. It grows by
levels from these counts: they are added up by quantile, node, feature and bin, which is a table of bounded size whatever the
number of rows, and from which the driver picks the splits. A leaf's value is the quantile of its residuals. What is shuffled
are these sums, combined before the shuffle; rows are read where they are, and their predictions are expressions over the bins.
"""

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketlens.plans.lineage import checkpoint

#: Splits by node; the root is 1, the children of node n are 2n and 2n + 1.
Splits = dict[int, tuple[int, int]]


@dataclass
class Tree:
    splits: Splits = field(default_factory=dict)
    values: dict[int, float] = field(default_factory=dict)

    def node(self, at: int = 1) -> Column:
        if at not in self.splits:
            return F.lit(at)
        feature, upto = self.splits[at]
        return F.when(F.get("bins", F.lit(feature)) <= upto, self.node(2 * at)).otherwise(self.node(2 * at + 1))

    def value(self, rate: float, at: int = 1) -> Column:
        if at not in self.splits:
            return F.lit(rate * self.values.get(at, 0.0))
        feature, upto = self.splits[at]
        return F.when(F.get("bins", F.lit(feature)) <= upto, self.value(rate, 2 * at)).otherwise(self.value(rate, 2 * at + 1))


def best_split(cells: list[tuple[int, int, int, float]], least: int) -> tuple[int, int] | None:
    """(feature, bin) after which to cut, of a node's (feature, bin, rows, gradients); None where no cut is worth it or leaves enough rows."""
    best, found = 1e-9, None
    for feature in sorted({f for f, _, _, _ in cells}):
        rows = sorted((b, n, g) for f, b, n, g in cells if f == feature)
        n_all, g_all = sum(n for _, n, _ in rows), sum(g for _, _, g in rows)
        n_left = g_left = 0.0
        for b, n, g in rows[:-1]:
            n_left, g_left = n_left + n, g_left + g
            n_right, g_right = n_all - n_left, g_all - g_left
            if min(n_left, n_right) >= least:
                gain = g_left**2 / n_left + g_right**2 / n_right - g_all**2 / n_all
                if gain > best:
                    best, found = gain, (feature, b)
    return found


@dataclass
class QuantileTrees:
    """fit, then predict adds a column q0, q1, ... for each quantile; predictions of a row do not cross."""

    label: str
    numbers: list[str]
    kinds: list[str]
    quantiles: tuple[float, ...] = (0.1, 0.5, 0.9)
    trees: int = 12
    depth: int = 3
    rate: float = 0.5
    bins: int = 32
    least: int = 20

    def with_bins(self, rows: DataFrame) -> DataFrame:
        for kind, means in self.means.items():
            rows = rows.join(means, F.col(kind).eqNullSafe(F.col(f"__{kind}")), "left").drop(f"__{kind}")
        values = [*[F.coalesce(f"__mean_{k}", F.lit(self.mean)) for k in self.kinds], *[F.col(n).cast("double") for n in self.numbers]]
        cut = lambda v, edges: F.size(F.filter(F.array(*[F.lit(e) for e in edges]).cast("array<double>"), lambda e: e < v))
        if not hasattr(self, "edges"):
            shares = [i / self.bins for i in range(1, self.bins)]
            found = rows.agg(*[F.percentile_approx(v, shares, 10_000).alias(f"e{i}") for i, v in enumerate(values)]).first()
            self.edges = [sorted(set(e or [])) for e in found]
        return rows.withColumn("bins", F.array(*[cut(v, e) for v, e in zip(values, self.edges, strict=True)])).drop(*[f"__mean_{k}" for k in self.kinds])

    def fit(self, rows: DataFrame) -> "QuantileTrees":
        """rows needs the label and the features; a kind is known by the mean label of its training rows, an unknown one by that of all."""
        rows = rows.select(self.label, *self.numbers, *self.kinds)
        first = rows.agg(F.avg(self.label), F.percentile_approx(self.label, list(self.quantiles), 10_000)).first()
        self.mean, self.start = float(first[0] or 0.0), [float(x) for x in (first[1] or [0.0] * len(self.quantiles))]
        self.means = {k: checkpoint(rows.groupBy(F.col(k).alias(f"__{k}")).agg(F.avg(self.label).alias(f"__mean_{k}"))) for k in self.kinds}
        data = checkpoint(self.with_bins(rows).select(F.col(self.label).cast("double").alias("y"), "bins"))
        self.model: list[list[Tree]] = [[] for _ in self.quantiles]
        for _ in range(self.trees):
            grown = [Tree() for _ in self.quantiles]
            scores = [self.score(i) for i in range(len(self.quantiles))]
            sums = self.sums(data, scores)
            for _ in range(self.depth):
                self.split(sums, grown)
            rest = F.explode(F.array(*[F.struct(F.lit(i).alias("q"), t.node().alias("node"), (F.col("y") - s).alias("rest")) for i, (t, s) in enumerate(zip(grown, scores, strict=True))]))
            leaves = data.select(rest.alias("x")).select("x.*").groupBy("q", "node").agg(F.percentile_approx("rest", list(self.quantiles), 10_000).alias("at"))
            for r in leaves.collect():
                grown[r["q"]].values[r["node"]] = r["at"][r["q"]]
            for own, tree in zip(self.model, grown, strict=True):
                own.append(tree)
        return self

    def sums(self, data: DataFrame, scores: list[Column]) -> DataFrame:
        """(bins, n, above): rows by all their bins, and for each quantile those above its score: all that the levels of a tree need of the rows."""
        above = [F.count_if(F.col("y") > s).alias(f"a{i}") for i, s in enumerate(scores)]
        each = data.groupBy("bins").agg(F.count(F.lit(1)).alias("n"), *above)
        return checkpoint(each.select("bins", "n", F.array(*[f"a{i}" for i in range(len(scores))]).alias("above")))

    def split(self, sums: DataFrame, grown: list[Tree]) -> None:
        """One level of a tree for each quantile."""
        size = len(self.kinds) + len(self.numbers)
        each = F.explode(F.array(*[F.struct(F.lit(i).alias("q"), t.node().alias("node"), F.col("above")[i].alias("a")) for i, t in enumerate(grown)]))
        cells = sums.select("bins", "n", each.alias("x")).select("bins", "n", "x.*").select("q", "node", "n", "a", F.posexplode("bins").alias("feature", "bin"))
        # A row above its score has the gradient q, any other q - 1.
        found = cells.groupBy("q", "node", "feature", "bin").agg(F.sum("n").alias("n"), F.sum("a").alias("a")).collect()
        nodes: dict[tuple[int, int], list] = {}
        for r in found:
            nodes.setdefault((r["q"], r["node"]), []).append((r["feature"], r["bin"], r["n"], self.quantiles[r["q"]] * r["n"] - (r["n"] - r["a"])))
        for (q, node), own in nodes.items():
            assert len(own) <= size * self.bins
            if (cut := best_split(own, self.least)) is not None:
                grown[q].splits[node] = cut

    def score(self, i: int) -> Column:
        out = F.lit(self.start[i])
        for tree in self.model[i]:
            out = out + tree.value(self.rate)
        return out

    def predict(self, rows: DataFrame) -> DataFrame:
        found = self.with_bins(rows).withColumn("__q", F.array_sort(F.array(*[self.score(i) for i in range(len(self.quantiles))])))
        return found.select(*rows.columns, *[F.col("__q")[i].alias(f"q{i}") for i in range(len(self.quantiles))])
