"""Pointer doubling, weighted medians and the stream table against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from docketlens.operators import delay
from docketlens.plans.lineage import ancestors
from docketlens.streaming import jobs


def walked(parents):
    out = {}
    for node in parents:
        at, steps, seen = node, 0, set()
        while parents.get(at) is not None and at not in seen:
            seen.add(at)
            at, steps = parents[at], steps + 1
        out[node] = (None, -1) if at in seen else (at if steps else None, steps)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_ancestors(spark, seed):
    r = random.Random(seed)
    parents = {i: r.choice([None, r.randrange(120), max(0, i - 1), 999]) for i in range(100)}  # trees, cycles, chains and parents that are no nodes
    parents |= {200: 200, 300: 301, 301: 300, 302: 300}
    parents |= {400 + i: 401 + i for i in range(70)} | {470: None}
    got = ancestors(spark.createDataFrame(list(parents.items()), "node long, parent long").repartition(3))
    assert {x["node"]: (x["top"], x["distance"]) for x in got.collect()} == walked(parents)
    assert ancestors(spark.createDataFrame([], "node long, parent long")).count() == 0


def weighted(rows):
    rows = sorted(rows)
    total, upto = sum(w for _, w in rows), 0
    for v, w in rows:
        upto += w
        if upto >= total / 2 * (1 - 1e-12):
            return v


def test_weighted_medians(spark):
    r = random.Random(4)
    rows = [(i, r.randrange(3), "st"[r.randrange(2)], r.choice("xyz"), r.randrange(9), f"200{r.randrange(9)}-05-0{r.randrange(1, 9)}") for i in range(200)]
    df = spark.createDataFrame(rows, "case_id long, court_id int, state string, case_type string, delay long, filed string").withColumn("filing_date", F.to_date("filed"))
    got = {tuple(x[k] for k in ("level", "court_id", "state", "case_type")): (x["weighted_median"], x["n"]) for x in delay.weighted_baselines(df, F.lit("2010-01-01").cast("date")).collect()}
    ages = {x["case_id"]: x["a"] for x in df.select("case_id", F.datediff(F.lit("2010-01-01").cast("date"), "filing_date").alias("a")).collect()}
    expected = {}
    for name, keys in delay.LEVELS:
        groups = {}
        for i, court, state, kind, days, _ in rows:
            key = tuple(v if k in keys else None for k, v in (("court_id", court), ("state", state), ("case_type", kind)))
            groups.setdefault(key, []).append((days, 0.5 ** (ages[i] / 730)))
        expected |= {(name, *k): (weighted(v), len(v)) for k, v in groups.items()}
    assert got == expected


def test_last_row_of_a_batch_wins(spark, tmp_path):
    done = []
    write = jobs.upsert_to(str(tmp_path), ["k"], "at", done)
    write(spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (2, 1, "c")], "k int, at int, v string"), 0)
    write(spark.createDataFrame([(2, 5, "e"), (2, 4, "d"), (3, 1, "f")], "k int, at int, v string"), 1)
    write(spark.createDataFrame([(2, 5, "e"), (2, 4, "d"), (3, 1, "f")], "k int, at int, v string"), 1)
    assert {(x["k"], x["v"]) for x in spark.read.parquet(str(tmp_path / "v1")).collect()} == {(1, "b"), (2, "e"), (3, "f")} and max(done) == 1


def test_settings_hold_inside_only(spark):
    before = spark.conf.get("spark.sql.ansi.enabled")
    with jobs.session_conf(spark, spark__sql__ansi__enabled="false"):
        assert spark.conf.get("spark.sql.ansi.enabled") == "false"
    assert spark.conf.get("spark.sql.ansi.enabled") == before
