"""Stored payloads and what the minimal parser reads from them, once and again (SRC, ING).

The pages of the tables are payloads; as they are no records of a court, each case gives one more, as a page, as JSON, as JSON
that is broken off, or as the text of a PDF, by its number.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketlens.plans.registry import query
from docketlens.sources.domain import Tables
from docketlens.sources.files import parse_minimal

HOST = r"^[a-z]+://([^/]+)"
#: Made payloads in the order of their numbers: media type and text, in which {k} is the case, {dmy}, {short} and {iso} its date and {p} its priority.
FORMS = (
    ("text/html", "<html><head><style>p { order: 1 }</style></head><body><h1>Case ID: C-{k}/1</h1><p>Date - {dmy}</p><!-- bench: nobody --><p> Bench:\n{p} </p><p>Order: put up &amp; heard</p><A href='/x.html'>x</A><a class=o HREF=\" /o/{k}.PDF \">order</a></body></html>"),
    ("text/html", "<div>CNR: {k}</div><div>Date: {short}</div><script>var outcome = 'Outcome: none';</script><p>Outcome: &lt;listed&gt;</p><p>Date: {iso}</p>"),
    ("application/json", '{"case_id": "C-{k}", "date": "{iso}", "bench": "{p}", "outcome": "heard", "order_pdf": "/o/{k}.pdf"}'),
    ("application/json", '[{"case_id": "", "cnr": {k}, "hearing_date": "{dmy}", "outcome_text": "listed"}, {"bench": "other"}]'),
    ("application/json", '{"case_id": "C-{k}", "date": '),
    ("application/pdf", "Case ID: C-{k}\nCoram: {p}\nheard on {short}\fDisposed  of with costs\nlisted"),
    ("application/pdf", "CNR - {k}\nlisted again\nAdjourned to {dmy}"),
    ("application/json; charset=utf-8", "{}"),
)


def filled(template: Column, values: dict[str, Column]) -> Column:
    for name, value in values.items():
        template = F.replace(template, F.lit("{" + name + "}"), value)
    return template


def payloads(t: Tables) -> DataFrame:
    """source, payload_id, media_type and payload."""
    pages = t.read("pages").select(F.regexp_extract("url", HOST, 1).alias("source"), F.concat(F.lit("page-"), "page_id").alias("payload_id"), F.lit("text/html").alias("media_type"), F.col("html").alias("payload"))
    form = F.get(F.array(*[F.struct(F.lit(m).alias("m"), F.lit(x).alias("x")) for m, x in FORMS]), (F.col("o_orderkey") % len(FORMS)).cast("int"))
    day = lambda pattern: F.date_format("o_orderdate", pattern)
    values = {"k": F.col("o_orderkey").cast("string"), "dmy": day("dd-MM-yyyy"), "short": day("d/M/yy"), "iso": day("yyyy-MM-dd"), "p": F.col("o_orderpriority")}
    made = t.read("orders").select(F.concat(F.lit("court/"), form["m"]).alias("source"), F.concat(F.lit("case-"), "o_orderkey").alias("payload_id"), form["m"].alias("media_type"), filled(form["x"], values).alias("payload"))
    return pages.unionByName(made)


_forms = lambda i: "CASE o_orderkey % 8 " + " ".join(f"WHEN {n} THEN '{f[i]}'" for n, f in enumerate((m, x.replace("'", "''").replace("\n", "' || chr(10) || '").replace("\f", "' || chr(12) || '")) for m, x in FORMS)) + " END"
_strip = lambda x: f"regexp_replace({x}, '^[\\s\\x{{a0}}]+|[\\s\\x{{a0}}]+$', '', 'g')"
_try = lambda *patterns: "nullif(coalesce(" + ", ".join(f"CASE WHEN regexp_matches(t, '(?i){p}') THEN {_strip(f"regexp_extract(t, '(?i){p}', 1)")} END" for p in patterns) + "), '')"
_key = lambda *keys: "coalesce(" + ", ".join(f"nullif(json_extract_string(record, '$.{k}'), '')" for k in keys) + ")"
_ID = (r"case\s*id\s*[:\-]\s*([A-Za-z0-9\-/]+)", r"cnr\s*[:\-]\s*([A-Za-z0-9\-/]+)")
_DAY = r"(\d{1,2}[\-/]\d{1,2}[\-/]\d{2,4})"
_LINE = r"\s*[:\-]\s*([^\n]+)"

#: The parser in DuckDB's SQL: stored payloads, their text, then the fields of each kind.
PARSED_PAYLOADS_SQL = rf""", stored AS (SELECT regexp_extract(url, '{HOST}', 1) AS source, 'page-' || page_id AS payload_id, 'text/html' AS media_type, html AS payload FROM pages
  UNION ALL SELECT 'court/' || media_type, payload_id, media_type, payload FROM (SELECT 'case-' || o_orderkey AS payload_id, {_forms(0)} AS media_type,
    replace(replace(replace(replace(replace({_forms(1)}, '{{k}}', CAST(o_orderkey AS VARCHAR)), '{{dmy}}', strftime(o_orderdate, '%d-%m-%Y')), '{{short}}', strftime(o_orderdate, '%-d/%-m/%y')), '{{iso}}', strftime(o_orderdate, '%Y-%m-%d')), '{{p}}', o_orderpriority) AS payload FROM orders)),
lay AS (SELECT *, CASE WHEN media_type LIKE '%pdf%' THEN 'pdf' WHEN media_type LIKE '%json%' THEN 'json' ELSE 'html' END AS kind, CASE WHEN media_type LIKE '%json%' THEN NOT json_valid(payload) ELSE false END AS broken FROM stored),
txt AS (SELECT *, CASE kind WHEN 'pdf' THEN replace(payload, chr(12), chr(10) || chr(10)) WHEN 'json' THEN CASE WHEN broken THEN '{{}}' ELSE payload END
  ELSE array_to_string(list_filter(list_transform(string_split(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(payload, '(?is)<script\b.*?(?:</script>|\z)|<style\b.*?(?:</style>|\z)|<!--.*?(?:-->|\z)', chr(1), 'g'), '<[^>]*>', chr(1), 'g'), '&nbsp;', chr(160)), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), chr(1)), lambda x: {_strip("x")}), lambda x: x <> ''), chr(10)) END AS t FROM lay),
rec AS (SELECT *, CASE WHEN kind = 'json' THEN CASE WHEN t LIKE '[%' THEN json_extract(t, '$[0]') ELSE CAST(t AS JSON) END END AS record FROM txt),
fld AS (SELECT source, payload_id, kind, broken, t, payload,
  CASE kind WHEN 'json' THEN {_key("case_id", "cnr", "case_number")} ELSE {_try(*_ID)} END AS case_ref,
  CASE kind WHEN 'json' THEN {_key("date", "hearing_date")} WHEN 'pdf' THEN {_try(_DAY)} ELSE {_try(r"date\s*[:\-]\s*" + _DAY)} END AS hearing_date,
  CASE kind WHEN 'json' THEN {_key("bench")} WHEN 'pdf' THEN {_try("bench" + _LINE, "coram" + _LINE)} ELSE {_try("bench" + _LINE)} END AS bench,
  CASE kind WHEN 'json' THEN {_key("outcome", "outcome_text")} WHEN 'pdf' THEN {_try(r"(disposed\s+of[^\n]*)", r"(adjourned[^\n]*)", r"(listed[^\n]*)")} ELSE {_try("outcome" + _LINE, "order" + _LINE)} END AS outcome,
  CASE kind WHEN 'json' THEN {_key("order_pdf", "order_pdf_url")} WHEN 'html' THEN nullif(regexp_extract(payload, '(?is)<a\b[^>]*?\bhref\s*=\s*["'']\s*([^"''>]*?\.pdf)\s*["'']', 1), '') END AS pdf,
  CASE WHEN kind = 'pdf' THEN len(string_split(payload, chr(12))) ELSE CAST(ceil(length(t) / 1200) AS BIGINT) END AS pages FROM rec)"""


@query(
    "src_5_minimal_parse",
    PARSED_PAYLOADS_SQL + " SELECT source, payload_id, case_ref, hearing_date, bench, outcome, pdf, pages, broken, greatest(0, ((case_ref IS NOT NULL)::INT + (hearing_date IS NOT NULL)::INT + (bench IS NOT NULL)::INT + (outcome IS NOT NULL)::INT) / 4 - CASE WHEN broken THEN 0.1 ELSE 0 END) AS confidence FROM fld",
)
def minimal_parse(t: Tables) -> DataFrame:
    """The fields of every payload, its pages, whether it was broken, and the confidence."""
    return parse_minimal(payloads(t)).select("source", "payload_id", "case_ref", "hearing_date", "bench", "outcome", "pdf", F.size("snippets").cast("long").alias("pages"), (F.size("errors") > 0).alias("broken"), "confidence")


@query(
    "src_5_snippets",
    PARSED_PAYLOADS_SQL + ", sn AS (SELECT source, payload_id, kind, t, string_split(payload, chr(12)) AS parts, unnest(range(1, pages + 1)) AS page FROM fld) SELECT source, payload_id, page, md5(CASE WHEN kind = 'pdf' THEN substr(parts[page], 1, 600) ELSE substr(t, (page - 1) * 1200 + 1, 600) END) AS snippet_md5 FROM sn",
)
def page_snippets(t: Tables) -> DataFrame:
    """One row for each page of a payload's text, with a digest of its snippet."""
    each = parse_minimal(payloads(t)).select("source", "payload_id", F.explode("snippets").alias("s"))
    return each.select("source", "payload_id", F.col("s.page").cast("long").alias("page"), F.md5(F.col("s.snippet").cast("binary")).alias("snippet_md5"))


@query("ing_12_reprocess", PARSED_PAYLOADS_SQL + " SELECT source, count(*) AS payloads, count(*) FILTER (coalesce(case_ref, hearing_date, bench, outcome) IS NOT NULL) AS recovered, count(*) FILTER (broken) AS failed FROM fld GROUP BY 1")
def reprocess(t: Tables) -> DataFrame:
    """Stored payloads parsed again by source: how many there are, gave a field, and were broken."""
    again = parse_minimal(payloads(t))
    return again.groupBy("source").agg(F.count(F.lit(1)).alias("payloads"), F.count_if(F.col("confidence") > 0).alias("recovered"), F.count_if(F.size("errors") > 0).alias("failed"))
