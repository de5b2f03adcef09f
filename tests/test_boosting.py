"""Quantile trees: splits against all cuts, losses, coverage and odd rows."""

import random

import pytest
from pyspark.sql import functions as F

from docketlens.plans.boosting import QuantileTrees, best_split


def test_best_split_is_the_best_of_all_cuts():
    r = random.Random(2)
    for _ in range(50):
        cells = [(f, b, r.randint(1, 9), r.uniform(-3, 3)) for f in range(3) for b in range(6)]
        cells = [c if c[0] == 0 else (*c[:2], cells[c[1]][2], cells[c[1]][3]) if c[0] == 1 else c for c in cells]
        score = {}
        for f in range(3):
            n, g = sum(c[2] for c in cells if c[0] == f), sum(c[3] for c in cells if c[0] == f)
            for b in range(5):
                left = [c for c in cells if c[0] == f and c[1] <= b]
                nl, gl = sum(c[2] for c in left), sum(c[3] for c in left)
                if min(nl, n - nl) >= 4:
                    score[f, b] = gl**2 / nl + (g - gl) ** 2 / (n - nl) - g**2 / n
        top = max(score.values())
        found = best_split(cells, 4)
        assert found is None if top <= 1e-9 else score[found] == pytest.approx(top)


@pytest.fixture(scope="module")
def noisy(spark):
    r = random.Random(1)
    rows = []
    for i in range(3000):
        kind, x = r.choice("abc"), r.random()
        rows.append((i, {"a": 0.0, "b": 50.0, "c": 100.0}[kind] + 40 * (x > 0.5) + r.uniform(-10, 10), x, kind))
    return spark.createDataFrame(rows, "id long, y double, x double, kind string").repartition(4)


def test_quantiles_of_noise(noisy):
    train, test = noisy.where("id % 3 <> 0"), noisy.where("id % 3 = 0")
    found = QuantileTrees("y", ["x"], ["kind"]).fit(train).predict(test)
    assert found.columns == [*test.columns, "q0", "q1", "q2"]
    r = found.agg(F.avg((F.col("y") < F.col("q0")).cast("double")), F.avg((F.col("y") < F.col("q2")).cast("double")), F.avg(F.abs(F.col("y") - F.col("q1"))), F.count_if(F.col("q0") > F.col("q2"))).first()
    assert 0.05 < r[0] < 0.17 and 0.83 < r[1] < 0.95 and r[2] < 8 and r[3] == 0


def test_more_trees_lose_less(noisy):
    loss = []
    for n in (0, 3, 8):
        found = QuantileTrees("y", ["x"], ["kind"], trees=n).fit(noisy).predict(noisy)
        rest = F.col("y") - F.col("q1")
        loss.append(found.agg(F.avg(F.when(rest > 0, 0.5 * rest).otherwise(-0.5 * rest))).first()[0])
    assert loss[0] > 1.5 * loss[1] and loss[1] > loss[2]


def test_odd_rows(spark, noisy):
    model = QuantileTrees("y", ["x"], ["kind"], trees=2).fit(noisy)
    odd = spark.createDataFrame([(1, None, None), (2, 0.5, "unknown"), (3, float("nan"), "a")], "id long, x double, kind string")
    assert all(r["q0"] is not None and r["q0"] <= r["q1"] <= r["q2"] for r in model.predict(odd).collect())
    few = QuantileTrees("y", ["x"], ["kind"], trees=2).fit(noisy.limit(1)).predict(odd).collect()
    assert len({(r["q0"], r["q2"]) for r in few}) == 1
    assert QuantileTrees("y", ["x"], ["kind"], trees=1).fit(noisy.limit(0)).predict(odd).count() == 3


def test_levels_of_a_tree_need_counts_by_bins_only(spark):
    rows = [(float(i % 7), [i % 3, i % 2]) for i in range(60)]
    trees = QuantileTrees("y", ["a", "b"], [], quantiles=(0.5, 0.9))
    got = {tuple(r["bins"]): (r["n"], list(r["above"])) for r in trees.sums(spark.createDataFrame(rows, "y double, bins array<int>"), [F.lit(2.0), F.lit(5.0)]).collect()}
    expected = {}
    for y, bins in rows:
        n, above = expected.get(tuple(bins), (0, [0, 0]))
        expected[tuple(bins)] = (n + 1, [above[0] + (y > 2), above[1] + (y > 5)])
    assert got == expected
