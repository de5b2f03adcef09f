"""Streams against their batch forms; file sources and sinks."""

import collections
import time

import pytest
from pyspark.sql import functions as F

from docketlens.sources import files
from docketlens.streaming import jobs


def drain(df, tmp_path, mode="append"):
    out = str(tmp_path / "out")
    df.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(out).awaitTermination()
    return df.sparkSession.read.parquet(out)


@pytest.fixture
def stream(spark, small, tmp_path):
    events = spark.read.parquet(f"{small}/events.parquet")
    for day in ("2024-01-11", "2024-01-21", "2024-03-01"):  # files in the order of their times, so that no row is late
        part = events.where((F.col("ts") < day) & (F.col("ts") >= {"2024-01-11": "2000-01-01", "2024-01-21": "2024-01-11", "2024-03-01": "2024-01-21"}[day]))
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)
    return events, spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


@pytest.mark.parametrize("job", [jobs.run_counts, jobs.sliding_counts, jobs.sessions])
def test_windows_that_have_closed(job, stream, tmp_path):
    batch, live = stream
    expected, got = (collections.Counter(map(tuple, d.collect())) for d in (job(batch), drain(job(live), tmp_path)))
    assert got and not got - expected


def test_dedupe(stream, tmp_path):
    batch, live = stream
    twice = live.union(live)
    assert drain(jobs.first_seen(twice), tmp_path).count() == batch.select("event_id").distinct().count()


def test_upsert(stream, tmp_path):
    batch, live = stream
    path = str(tmp_path / "table")
    query = live.select("user_id", "event_id").writeStream.foreachBatch(jobs.upsert_to(path, ["user_id"])).option("checkpointLocation", str(tmp_path / "s")).trigger(availableNow=True).start()
    query.awaitTermination()
    last = max((tmp_path / "table").iterdir(), key=lambda p: int(p.name[1:]))
    rows = batch.sparkSession.read.parquet(str(last))
    assert rows.count() == batch.select("user_id").distinct().count()


def test_officials(spark, tmp_path):
    (tmp_path / "o.csv").write_text("full_name,role,source\n A ,x,y\n,x,y\nA,z,y\nB,x,y\n")
    known = spark.createDataFrame([("B",)], "full_name string")
    assert [r["full_name"] for r in files.import_officials(spark, str(tmp_path / "o.csv"), known).collect()] == ["A"]


def test_minimal_parse(spark):
    page = "<pre>Case ID: CRL/12/2024\nDate: 3-2-2024\nBench: A.B. Sharma\nOutcome: Adjourned</pre><a href='x/order.pdf'>o</a>"
    rows = [
        (0, "text/html", page),
        (1, "text/html", ""),
        (2, None, None),
        (3, "text/html", "<p>Date: 2024-02-03</p><p>CNR - AB-1</p><b>Order</b>: no<style>bench: x</style><p>Order: x&amp;y</p>"),
        (4, "application/json", '[{"case_number": 7, "hearing_date": "2024-02-03", "bench": null, "outcome_text": "listed", "order_pdf_url": "u.pdf"}]'),
        (5, "application/json", '{"case_id": '),
        (6, "application/PDF", "Coram: C. D.\nCase ID: 9\fon 1/2/24 it was Listed for orders\nand adjourned sine die"),
        (7, "text/html", "<p>" + "x" * 2401 + "</p>"),
    ]
    found = files.parse_minimal(spark.createDataFrame(rows, "id int, media_type string, payload string")).collect()
    got = {r["id"]: tuple(r[c] for c in ("case_ref", "hearing_date", "bench", "outcome", "pdf", "confidence")) for r in found}
    assert got == {
        0: ("CRL/12/2024", "3-2-2024", "A.B. Sharma", "Adjourned", "x/order.pdf", 1.0),
        1: (None, None, None, None, None, 0.0),
        2: (None, None, None, None, None, 0.0),
        3: ("AB-1", None, None, "no", None, 0.5),
        4: ("7", "2024-02-03", None, "listed", "u.pdf", 0.75),
        5: (None, None, None, None, None, 0.0),
        6: ("9", "1/2/24", "C. D.", "adjourned sine die", None, 1.0),
        7: (None, None, None, None, None, 0.0),
    }
    pages = {r["id"]: [(s["page"], len(s["snippet"])) for s in r["snippets"]] for r in found}
    assert pages[1] == pages[2] == [] and pages[7] == [(1, 600), (2, 600), (3, 1)] and [p for p, _ in pages[6]] == [1, 2]
    assert [r["errors"] for r in found if r["errors"]] == [["json_decode_error"]]


@pytest.mark.parametrize("kind", ["csv", "json", "parquet"])
def test_exports(spark, tmp_path, kind):
    df = spark.range(10).select("id", F.concat(F.lit("n"), F.col("id").cast("string")).alias("name"))
    files.export(df, str(tmp_path / kind), kind, compress=True)
    back = spark.read.format(kind).option("header", True).load(str(tmp_path / kind))
    assert sorted(r["name"] for r in back.collect()) == sorted(r["name"] for r in df.collect())
