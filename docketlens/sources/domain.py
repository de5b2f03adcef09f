"""Domain views over the generated tables: courts, cases, hearings, adjournments, applications.

Orders stand in for cases, their lines for hearings, nations for courts and suppliers for judges and advocates. The
reference date is a constant here and a parameter of every operator.
"""

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "2001-12-31"


class Tables:
    """The tables of one folder, and the views over them. Nothing is read before an action."""

    def __init__(self, spark: SparkSession, sf_dir: str, as_of: str = AS_OF):
        self.spark, self.sf_dir, self.as_of_text = spark, sf_dir, as_of
        self.as_of = F.lit(as_of).cast("date")

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def courts(self) -> DataFrame:
        region = self.read("region").select("r_regionkey", F.col("r_name").alias("state"))
        nation = self.read("nation").select(F.col("n_nationkey").alias("court_id"), F.col("n_name").alias("court"), "n_regionkey")
        level = F.when(F.col("court_id") % 3 == 0, "high").otherwise("district")
        return nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select("court_id", "court", "state", level.alias("court_level"))

    @cached_property
    def cases(self) -> DataFrame:
        """One row per case. Scores that other jobs would have stored follow from its number."""
        orders = self.read("orders").select(
            F.col("o_orderkey").alias("case_id"),
            F.col("o_custkey"),
            F.create_map(F.lit("F"), F.lit("disposed"), F.lit("O"), F.lit("pending"), F.lit("P"), F.lit("in_progress"))[F.col("o_orderstatus")].alias("status"),
            F.to_date("o_orderdate").alias("filing_date"),
            F.col("o_orderpriority").alias("priority"),
            F.col("o_totalprice").alias("amount"),
        )
        party = self.read("customer").select("c_custkey", F.col("c_nationkey").alias("court_id"), F.lower("c_mktsegment").alias("case_type"), F.col("c_name").alias("party_name"))
        n = F.col("case_id")
        importance = F.when(n % 17 != 0, (n % 101) / 100)
        next_hearing = F.when((F.col("status") != "disposed") & (n % 4 != 0), F.date_add(self.as_of, (n % 90 - 30).cast("int")))
        joined = orders.join(party, F.col("o_custkey") == F.col("c_custkey")).join(self.courts, "court_id")
        return joined.select("case_id", "court_id", "court", "court_level", "state", "case_type", "status", (F.col("status") == "disposed").alias("is_disposed"), "filing_date", "priority", "amount", "party_name", importance.alias("importance"), next_hearing.alias("next_hearing_date"))

    @cached_property
    def hearings(self) -> DataFrame:
        flag, state = F.col("l_returnflag"), F.col("l_linestatus")
        outcome = F.when(flag == "R", "ADJOURNED").when(flag == "A", "HEARD").when(state == "F", "LISTED").otherwise("NOT_REACHED")
        return self.read("lineitem").select(
            F.col("l_orderkey").alias("case_id"),
            F.to_date("l_shipdate").alias("date"),
            F.col("l_suppkey").alias("judge_id"),
            outcome.alias("outcome_type"),
            (F.col("l_quantity") / 50).alias("confidence"),
            F.col("l_linenumber").alias("line"),
            F.col("l_partkey").alias("part"),
            F.col("l_extendedprice").alias("price"),
            F.col("l_discount").alias("discount"),
            F.col("l_tax").alias("tax"),
            F.col("l_linestatus").alias("linestatus"),
        )

    @cached_property
    def adjournments(self) -> DataFrame:
        reasons = F.array(*[F.lit(r) for r in REASONS])
        h = self.hearings.where(F.col("outcome_type") == "ADJOURNED")
        return h.select("case_id", "date", "line", "part", "judge_id", F.get(reasons, F.col("line") % 10).alias("reason_type"), F.when(F.col("discount") >= 0.05, F.col("judge_id")).alias("requested_by"), (F.col("tax") >= 0.04).alias("was_contested"))

    @cached_property
    def applications(self) -> DataFrame:
        h = self.hearings.where(F.col("linestatus") == "O")
        status = F.when(F.col("tax") < 0.02, "granted").when(F.col("tax") < 0.04, "rejected").when(F.col("tax") < 0.06, "dismissed").otherwise("pending")
        kinds = F.array(*[F.lit(k) for k in APPLICATIONS])
        days = F.round(F.col("confidence") * 50).cast("int")
        return h.select("case_id", "date", "line", "part", F.col("judge_id").alias("advocate_id"), F.get(kinds, (F.col("part") % 9).cast("int")).alias("application_type"), status.alias("decision_status"), F.date_add("date", days).alias("decision_date"), days.cast("long").alias("delay_days"), (F.col("discount") >= 0.08).alias("is_frivolous"))

    @cached_property
    def last_hearings(self) -> DataFrame:
        return self.hearings.groupBy("case_id").agg(F.max("date").alias("last_hearing"), F.min("date").alias("first_hearing"), F.count(F.lit(1)).alias("n_hearings"), F.count_if(F.col("outcome_type") == "ADJOURNED").alias("n_adjourned"))

    @cached_property
    def case_spans(self) -> DataFrame:
        """Cases with what their hearings say: counts, and the disposal date, which is the last hearing of a disposed case."""
        joined = self.cases.join(self.last_hearings, "case_id", "left")
        return joined.select("*", F.when(F.col("is_disposed"), F.col("last_hearing")).alias("disposal_date")).fillna(0, ["n_hearings", "n_adjourned"])


#: Adjournment reasons and application types, in the order of their numbers.
REASONS = ("on_request", "court_adjourned", "file_not_ready", "judge_unavailable", "counsel_unavailable", "interim_pending", "compliance_pending", "party_not_ready", "other_procedural", "unspecified")
APPLICATIONS = ("bail", "stay_of_proceedings", "injunction", "interim_relief", "recall", "review", "clarification", "suspension", "other")

_case = lambda number, names: "CASE " + number + " " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(names)) + " END"

#: The same views in DuckDB's SQL, for the independent check.
VIEWS_SQL = f"""
courts AS (SELECT n_nationkey AS court_id, n_name AS court, r_name AS state, CASE WHEN n_nationkey % 3 = 0 THEN 'high' ELSE 'district' END AS court_level
           FROM nation JOIN region ON n_regionkey = r_regionkey),
cases AS (SELECT o_orderkey AS case_id, court_id, court, court_level, state, lower(c_mktsegment) AS case_type,
                 CASE o_orderstatus WHEN 'F' THEN 'disposed' WHEN 'O' THEN 'pending' WHEN 'P' THEN 'in_progress' END AS status,
                 o_orderstatus = 'F' AS is_disposed, CAST(o_orderdate AS DATE) AS filing_date, o_orderpriority AS priority, o_totalprice AS amount, c_name AS party_name,
                 CASE WHEN o_orderkey % 17 <> 0 THEN (o_orderkey % 101) / 100 END AS importance,
                 CASE WHEN o_orderstatus <> 'F' AND o_orderkey % 4 <> 0 THEN DATE '{AS_OF}' + CAST(o_orderkey % 90 - 30 AS INTEGER) END AS next_hearing_date
          FROM orders JOIN customer ON o_custkey = c_custkey JOIN courts ON c_nationkey = court_id),
hearings AS (SELECT l_orderkey AS case_id, CAST(l_shipdate AS DATE) AS date, l_suppkey AS judge_id,
                    CASE WHEN l_returnflag = 'R' THEN 'ADJOURNED' WHEN l_returnflag = 'A' THEN 'HEARD' WHEN l_linestatus = 'F' THEN 'LISTED' ELSE 'NOT_REACHED' END AS outcome_type,
                    l_quantity / 50 AS confidence, l_linenumber AS line, l_partkey AS part, l_extendedprice AS price, l_discount AS discount, l_tax AS tax, l_linestatus AS linestatus
             FROM lineitem),
adjournments AS (SELECT case_id, date, line, part, judge_id, {_case("line % 10", REASONS)} AS reason_type,
                        CASE WHEN discount >= 0.05 THEN judge_id END AS requested_by, tax >= 0.04 AS was_contested
                 FROM hearings WHERE outcome_type = 'ADJOURNED'),
applications AS (SELECT case_id, date, line, part, judge_id AS advocate_id, {_case("part % 9", APPLICATIONS)} AS application_type,
                        CASE WHEN tax < 0.02 THEN 'granted' WHEN tax < 0.04 THEN 'rejected' WHEN tax < 0.06 THEN 'dismissed' ELSE 'pending' END AS decision_status,
                        date + CAST(round(confidence * 50) AS INTEGER) AS decision_date, CAST(round(confidence * 50) AS BIGINT) AS delay_days, discount >= 0.08 AS is_frivolous
                 FROM hearings WHERE linestatus = 'O'),
last_hearings AS (SELECT case_id, max(date) AS last_hearing, min(date) AS first_hearing, count(*) AS n_hearings, count(*) FILTER (outcome_type = 'ADJOURNED') AS n_adjourned FROM hearings GROUP BY 1),
case_spans AS (SELECT cases.*, last_hearing, first_hearing, coalesce(n_hearings, 0) AS n_hearings, coalesce(n_adjourned, 0) AS n_adjourned, CASE WHEN is_disposed THEN last_hearing END AS disposal_date
               FROM cases LEFT JOIN last_hearings USING (case_id))"""

#: Outcome phrases, which the generated corpus lacks.
PHRASES = (
    "Matter adjourned to next week",
    "Case postponed due to strike",
    "Put up on 22.03.2026",
    "Arguments heard",
    "Order reserved",
    "Dismissed with costs",
    "Not heard on account of paucity of time",
    "",
    "Matter mentioned",
    "Proxy counsel appearing, lead counsel absent",
    "Defect in filing, filing fee not paid",
    "Judge is on leave, bench did not assemble",
    "Interim order to continue, stay extended",
    "No proceedings",
    "Adjourned to 04.05.2026: counsel not present",
    "Petition allowed and disposed of",
    "adj.04.05.2026",
    "adj. for want of time",
    "Adjd to 4 May on the request of both parties, who ask for time to settle the matter",
)


def with_text(hearings: DataFrame) -> DataFrame:
    """Hearings with an outcome text, one of the phrases by their numbers."""
    texts = F.array(*[F.lit(p) for p in PHRASES])
    return hearings.withColumn("text", F.get(texts, ((F.col("case_id") + F.col("line")) % len(PHRASES)).cast("int")))


PHRASES_SQL = "[" + ", ".join("'" + p.replace("'", "''") + "'" for p in PHRASES) + "]"
TEXT_SQL = f", texts AS (SELECT *, list_extract({PHRASES_SQL}, CAST((case_id + line) % {len(PHRASES)} AS INTEGER) + 1) AS text FROM hearings)"
