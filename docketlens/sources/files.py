"""File sources and sinks: CSV import, minimal parsing of payloads, exports in four formats."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CASE_REF = (r"case\s*id\s*[:\-]\s*([A-Za-z0-9\-/]+)", r"cnr\s*[:\-]\s*([A-Za-z0-9\-/]+)")
#: Patterns of the fields in a page and in the text of a PDF, and the keys of a JSON record, in the order in which they are tried.
HTML_FIELDS = {
    "case_ref": CASE_REF,
    "hearing_date": (r"date\s*[:\-]\s*(\d{1,2}[\-/]\d{1,2}[\-/]\d{2,4})",),
    "bench": (r"bench\s*[:\-]\s*([^\n]+)",),
    "outcome": (r"outcome\s*[:\-]\s*([^\n]+)", r"order\s*[:\-]\s*([^\n]+)"),
}
PDF_FIELDS = {
    "case_ref": CASE_REF,
    "hearing_date": (r"(\d{1,2}[\-/]\d{1,2}[\-/]\d{2,4})",),
    "bench": (r"bench\s*[:\-]\s*([^\n]+)", r"coram\s*[:\-]\s*([^\n]+)"),
    "outcome": (r"(disposed\s+of[^\n]*)", r"(adjourned[^\n]*)", r"(listed[^\n]*)"),
}
JSON_FIELDS = {
    "case_ref": ("case_id", "cnr", "case_number"),
    "hearing_date": ("date", "hearing_date"),
    "bench": ("bench",),
    "outcome": ("outcome", "outcome_text"),
    "pdf": ("order_pdf", "order_pdf_url"),
}
#: Characters of a page of text, of a page's snippet, and what an error takes off the confidence, at most.
PAGE, SNIPPET, PENALTY, MOST_PENALTY = 1200, 600, 0.1, 0.4
#: What a page shows no reader, its tags, and the references that are decoded, the ampersand last.
HIDDEN, TAG = r"(?is)<script\b.*?(?:</script>|\z)|<style\b.*?(?:</style>|\z)|<!--.*?(?:-->|\z)", r"<[^>]*>"
REFERENCES = (("&nbsp;", "\u00a0"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))


def import_officials(spark: SparkSession, path: str, known: DataFrame) -> DataFrame:
    """New officials from a CSV with full_name, role and source: trimmed, without blanks and names already known (SRC-2)."""
    rows = spark.read.csv(path, header=True, schema="full_name string, role string, source string")
    clean = rows.select(*[F.trim(c).alias(c) for c in rows.columns]).where("full_name <> ''")
    return clean.dropDuplicates(["full_name"]).join(known.select("full_name"), "full_name", "left_anti")


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^[\s\u00a0]+|[\s\u00a0]+$", "")


def picked(text: Column, patterns: tuple[str, ...]) -> Column:
    """What the first pattern that matches finds, stripped; null where that is empty or none matches."""
    found = F.coalesce(*[F.when(text.rlike(f"(?i){p}"), stripped(F.regexp_extract(text, f"(?i){p}", 1))) for p in patterns])
    return F.nullif(found, F.lit(""))


def page_text(html: Column) -> Column:
    """The pieces of text of a page, each stripped, one a line."""
    text = F.regexp_replace(F.regexp_replace(html, HIDDEN, "\u0001"), TAG, "\u0001")
    for name, letter in REFERENCES:
        text = F.replace(text, F.lit(name), F.lit(letter))
    return F.array_join(F.filter(F.transform(F.split(text, "\u0001"), stripped), lambda x: x != ""), "\n")


def snippets(text: Column) -> Column:
    """Number and first characters of every page of so many characters; none for an empty text."""
    pages = F.sequence(F.lit(1), F.ceil(F.char_length(text) / PAGE).cast("int"))
    one = lambda i: F.struct(i.alias("page"), F.substring(text, (i - 1) * PAGE + 1, F.lit(SNIPPET)).alias("snippet"))
    return F.when(F.char_length(text) > 0, F.transform(pages, one)).otherwise(F.array().cast("array<struct<page:int,snippet:string>>"))


def parse_minimal(payloads: DataFrame, payload: str = "payload", media_type: str = "media_type") -> DataFrame:
    """Fields, the linked PDF, snippets of each page, errors and confidence of payloads by their media type (SRC-5).

    A PDF comes as its text with a form feed between pages, and its snippets follow its pages. JSON gives its first record
    where it is a list; JSON that does not parse is an error and gives no field. All else is read as a page. The confidence is
    the share of the four fields that are found, less a penalty for each error. A null payload is empty.
    """
    kind, body = F.lower(F.coalesce(F.col(media_type), F.lit(""))), F.coalesce(F.col(payload), F.lit(""))
    is_pdf, is_json = kind.contains("pdf"), kind.contains("json") & ~kind.contains("pdf")
    broken = is_json & F.try_parse_json(body).isNull()
    text = F.when(is_pdf, F.replace(body, F.lit("\f"), F.lit("\n\n"))).when(broken, "{}").when(is_json, body).otherwise(page_text(body))
    read = payloads.withColumns({"_pdf": is_pdf, "_json": is_json, "_broken": broken, "_body": body, "_text": text})
    is_list = F.ltrim("_text").startswith("[")

    def of_json(keys: tuple[str, ...]) -> Column:
        value = lambda k: F.when(is_list, F.get_json_object("_text", f"$[0].{k}")).otherwise(F.get_json_object("_text", f"$.{k}"))
        return F.coalesce(*[F.nullif(value(k), F.lit("")) for k in keys])

    def field(name: str) -> Column:
        text = F.col("_text")
        return F.when(F.col("_json"), of_json(JSON_FIELDS[name])).when(F.col("_pdf"), picked(text, PDF_FIELDS[name])).otherwise(picked(text, HTML_FIELDS[name]))

    link = F.nullif(F.regexp_extract("_body", r"""(?is)<a\b[^>]*?\bhref\s*=\s*["']\s*([^"'>]*?\.pdf)\s*["']""", 1), F.lit(""))
    pages = F.transform(F.split("_body", "\f"), lambda x, i: F.struct((i + 1).alias("page"), F.substring(x, 1, SNIPPET).alias("snippet")))
    out = read.withColumns(
        {name: field(name) for name in HTML_FIELDS}
        | {
            "pdf": F.when(F.col("_json"), of_json(JSON_FIELDS["pdf"])).when(~F.col("_pdf"), link),
            "snippets": F.when(F.col("_pdf"), pages).otherwise(snippets(F.col("_text"))),
            "errors": F.when(F.col("_broken"), F.array(F.lit("json_decode_error"))).otherwise(F.array().cast("array<string>")),
        }
    )
    found = sum((F.col(k).isNotNull().cast("int") for k in list(HTML_FIELDS)[1:]), F.col("case_ref").isNotNull().cast("int"))
    share = found / len(HTML_FIELDS) - F.least(F.lit(MOST_PENALTY), PENALTY * F.size("errors"))
    return out.withColumn("confidence", F.greatest(F.lit(0.0), share)).drop("_pdf", "_json", "_broken", "_body", "_text")


def export(df: DataFrame, path: str, kind: str, compress: bool = False) -> None:
    """Writes csv, json (one object a line) or parquet, gzip on request (SNK-3)."""
    writer = df.write.mode("overwrite")
    if compress:
        writer = writer.option("compression", "gzip")
    if kind == "csv":
        writer.option("header", True).csv(path)
    elif kind in ("json", "ndjson"):
        writer.json(path)
    elif kind == "parquet":
        writer.parquet(path)
    else:
        raise ValueError(f"unknown format: {kind}")


def read_export(spark: SparkSession, path: str, kind: str, schema) -> DataFrame:
    """Rows that export() wrote, by their schema; the compression is seen from the files' names."""
    reader = spark.read.schema(schema)
    return reader.csv(path, header=True) if kind == "csv" else reader.json(path) if kind in ("json", "ndjson") else reader.parquet(path)


def replace_all(df: DataFrame, path: str) -> None:
    """Rows in place of all that path held before (SNK-2). df must not read from path itself, and needs no path to be there yet."""
    df.write.mode("overwrite").parquet(path)
