"""Literal expectations of runs, drift scores, chunked streams and public texts on hand-made rows."""

import json
import re

import pytest
from pyspark.sql import functions as F

from docketlens.operators import ingestion
from docketlens.plans.lineage import row_numbers


def test_row_numbers_without_gaps(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x"), F.lit("same").alias("k")).repartition(5)
    rows = row_numbers(df, "k", "x").collect()
    assert all(r["rn"] == r["x"] for r in rows) and len(rows) == 1000
    assert row_numbers(df.limit(0), "x").count() == 0


def test_chunks_hold_so_many_rows_in_order(spark):
    df = spark.createDataFrame([(i, None if i == 3 else f"ü{i}") for i in reversed(range(7))], "id long, name string")
    chunks = ingestion.ndjson_chunks(df, ["id"], size=3).orderBy("chunk").collect()
    assert [c["n"] for c in chunks] == [3, 3, 1]
    lines = [json.loads(line) for c in chunks for line in c["payload"].splitlines()]
    assert lines == [{"id": i, "name": None if i == 3 else f"ü{i}"} for i in range(7)]
    assert all(c["payload"].endswith("\n") for c in chunks)


def test_status_of_a_run(spark):
    df = spark.createDataFrame([(0, 5, False), (0, 5, True), (2, 3, False), (5, 0, False), (0, 0, True)], "failed long, parsed long, drifted boolean")
    got = [r[0] for r in df.select(ingestion.run_status(F.col("failed"), F.col("parsed"), F.col("drifted"))).collect()]
    assert got == ["SUCCESS", "PARTIAL", "PARTIAL", "FAILED", "FAILED"]


def test_drift_against_the_page_before(spark):
    pages = [
        (1, "http://a.org/1", "<div><p>x</p><p>y</p><br></div>"),  # depths 1 2 2
        (2, "http://a.org/2", "<div><p>x</p><p>y</p><br></div>"),  # the same
        (3, "http://a.org/3", "<div><p>x</p></div>"),  # a p and a br fewer of 4 tags; depths 1 2
        (4, "http://b.org/1", "<div></div>"),  # another host's first page
        (5, "http://b.org/2", ""),  # one of one tag gone, and all of the depth
        (6, "http://b.org/3", ""),
    ]
    got = dict(ingestion.drift_scores(spark.createDataFrame(pages, "page_id long, url string, html string")).collect())
    assert got == {2: 0.0, 3: round(0.7 * 2 / 4 + 0.3 * (5 / 3 - 1.5) / (5 / 3), 4), 5: 1.0, 6: 0.0}


def by_hand(text, hides):
    for phrase, instead in ingestion.NEUTRAL:
        text = re.sub(re.escape(phrase), instead, text or "", flags=re.I)
    return re.sub(r"\b([A-Z][a-z]{2,}(?:\s+[A-Z][a-z]{2,})+)\b", ingestion.WITHHELD, text) if hides else text or ""


TEXTS = [
    "The report PROVES that Ram Kumar Sharma is guilty.",
    "Delay Caused By Anil Mehta,\nwho is responsible for it  ",
    "Émile Zola Dupont and Foo Baré, Foo Bar Bazé, Foo_Bar Baz Qux",
    "Al Bo",
    None,
    "",
    "Name " * 20000,
]


@pytest.mark.parametrize(("label", "confidence", "hides", "status"), [("UNVERIFIED", 0.9, True, "Unverified"), ("SENSITIVE", 0.9, True, "Verified"), ("OTHER", 0.9, False, "Verified"), (None, 0.69, True, "Verified"), (None, None, False, "Verified"), ("DATA_ANOMALY", 0.7, True, "Data anomaly")])
def test_public_texts(spark, label, confidence, hides, status):
    df = spark.createDataFrame([(i, x, label, confidence) for i, x in enumerate(TEXTS)], "i int, text string, label string, c double")
    said = "unknown" if confidence is None else f"{confidence:.2f}"
    rows = df.select("i", ingestion.public_text(F.col("text"), F.col("label"), F.col("c"), F.lit(2)).alias("r")).select("i", "r.*").orderBy("i").collect()
    for row, text in zip(rows, TEXTS, strict=True):
        assert row["status"] == status
        assert row["rendered"] == f"Data status: {status}. Sources: 2; parser confidence {said}.\n{by_hand(text, hides)}".strip()
        assert row["names"] == (by_hand(text, True).count(ingestion.WITHHELD) if hides else 0)
