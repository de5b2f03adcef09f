"""Replay of the steps of a record."""

from pyspark.sql import functions as F

from docketlens.operators.provenance import STEP, replayed


def test_replay_takes_the_last_value(spark):
    rows = [
        (0, [("a", "1", None), ("b", "2", "3")], "3"),
        (1, [("a", "1", "9"), ("b", "2", None), ("c", None, None)], "2"),
        (2, [("a", None, None)], None),
        (3, [], None),
        (4, None, None),
        (5, [("a", "", "x"), ("b", None, "")], ""),
    ]
    df = spark.createDataFrame(rows, f"id int, steps {STEP}, expected string").withColumn("got", replayed(F.col("steps")))
    assert [(r["id"], r["got"]) for r in df.orderBy("id").collect()] == [(i, e) for i, _, e in rows]
