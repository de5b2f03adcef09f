"""Rows that pass through files: imported officials, results that are replaced, exports in each format (SRC-2, SNK-2, SNK-3).

The files lie in the folder that all executors share, each run's in one of its own.
"""

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketlens.operators.delay import BASELINES_SQL, baselines, case_delays
from docketlens.plans.lineage import shared_folder
from docketlens.plans.registry import query
from docketlens.sources.domain import Tables
from docketlens.sources.files import export, import_officials, read_export, replace_all

ROLES = ("judge", "registrar", "clerk")
FORMATS = ("csv", "json", "parquet")


def _folder(t: Tables) -> str:
    return f"{shared_folder(t.spark)}/transfer-{uuid.uuid4().hex}"


@query(
    "src_2_imported_officials",
    f" SELECT s_name AS full_name, list_extract({list(ROLES)}, CAST(s_suppkey % 3 AS INTEGER) + 1) AS role, 'gazette' AS source FROM supplier WHERE s_suppkey % 7 <> 0 AND s_suppkey % 11 <> 0 AND s_suppkey % 10 <> 3",
)
def imported_officials(t: Tables) -> DataFrame:
    """Officials from a CSV file that has repeated rows, missing and blank names, and blanks around names; a name known in other letters is new."""
    n, name = F.col("s_suppkey"), F.col("s_name")
    suppliers = t.read("supplier")
    written = F.when(n % 7 == 0, None).when(n % 11 == 0, "  ").when(n % 2 == 0, F.concat(F.lit("  "), name, F.lit(" "))).otherwise(name)
    role = F.get(F.array(*[F.lit(r) for r in ROLES]), (n % 3).cast("int"))
    copies = F.explode(F.sequence(F.lit(1), F.when(n % 5 == 0, 3).otherwise(1)))
    rows = suppliers.select(written.alias("full_name"), role.alias("role"), F.lit(" gazette").alias("source"), copies.alias("copy")).drop("copy")
    path = f"{_folder(t)}/officials"
    rows.write.csv(path, header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    known = suppliers.where((n % 10).isin(3, 4)).select(F.when(n % 10 == 3, name).otherwise(F.lower(name)).alias("full_name"))
    return import_officials(t.spark, path, known)


@query("snk_2_replaced_baselines", BASELINES_SQL + " SELECT * FROM base")
def replaced_baselines(t: Tables) -> DataFrame:
    """The stored baselines after a run over three years and one over seven: the later run's rows alone."""
    path = f"{_folder(t)}/baselines"
    for years in (3, 7):
        replace_all(baselines(case_delays(t.case_spans, t.as_of, years)), path)
    return t.spark.read.parquet(path)


@query(
    "snk_3_exports",
    """ SELECT kind, compressed, court, count(*) AS cases, count(*) FILTER (is_disposed) AS disposed, min(filing_date) AS first_filing, max(filing_date) AS last_filing, CAST(sum(CAST(amount AS DECIMAL(15, 2))) AS DOUBLE) AS amount, CAST(sum(case_id * (1 + length(case_type))) AS BIGINT) AS checksum
    FROM cases, (VALUES ('csv'), ('json'), ('parquet')) f(kind), (VALUES (false), (true)) g(compressed) GROUP BY ALL""",
)
def exports(t: Tables) -> DataFrame:
    """Cases written in every format, plain and compressed, and what is read back from each, by court.

    The rows are made once, by the first export, from which the others are written.
    """
    folder = _folder(t)
    columns = ["case_id", "court", "case_type", "is_disposed", "filing_date", F.col("amount").cast("decimal(15,2)").alias("amount")]
    export(t.cases.select(*columns), first := f"{folder}/rows", "parquet")
    rows, back = t.spark.read.parquet(first), None
    for kind in FORMATS:
        for compress in (False, True):
            export(rows, path := f"{folder}/{kind}-{compress}", kind, compress)
            found = read_export(t.spark, path, kind, rows.schema).select("*", F.lit(kind).alias("kind"), F.lit(compress).alias("compressed"))
            back = found if back is None else back.unionByName(found)
    checksum = F.sum(F.col("case_id") * (1 + F.char_length("case_type"))).alias("checksum")
    dates = [F.min("filing_date").alias("first_filing"), F.max("filing_date").alias("last_filing")]
    return back.groupBy("kind", "compressed", "court").agg(F.count(F.lit(1)).alias("cases"), F.count_if("is_disposed").alias("disposed"), *dates, F.sum("amount").cast("double").alias("amount"), checksum)
