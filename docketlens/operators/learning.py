"""Duration models: features, data set, split, median baseline, linear model, evaluation and ratios (ML)."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docketlens.functions.numbers import clamp
from docketlens.operators.advocates import filing_backlog
from docketlens.plans.boosting import QuantileTrees
from docketlens.plans.lineage import checkpoint
from docketlens.plans.registry import query
from docketlens.sources.domain import Tables

#: Features that are kinds.
KINDS = ["court_level", "case_type", "state"]

SET_SQL = """, ds AS (SELECT case_id, court_level, case_type, state, filing_date, amount, date_diff('day', filing_date, disposal_date) AS days FROM case_spans WHERE is_disposed AND disposal_date IS NOT NULL AND date_diff('day', filing_date, disposal_date) > 0),
nu AS (SELECT *, row_number() OVER (ORDER BY filing_date, case_id) AS rn, count(*) OVER () AS n FROM ds), tr AS (SELECT * FROM nu WHERE rn <= floor(0.8 * n)), te AS (SELECT * FROM nu WHERE rn > floor(0.8 * n)),
md AS (SELECT court_level, case_type, median(days) AS m FROM tr GROUP BY ALL), pr AS (SELECT te.*, coalesce(m, (SELECT median(days) FROM tr)) AS predicted FROM te LEFT JOIN md USING (court_level, case_type))"""


def dataset(t: Tables) -> DataFrame:
    days = F.datediff("disposal_date", "filing_date").cast("long")
    return t.case_spans.where("is_disposed AND disposal_date IS NOT NULL").select("case_id", "court_level", "case_type", "state", "filing_date", "amount", days.alias("days")).where("days > 0")


def split(rows: DataFrame, share: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Training rows filed first and test rows filed last. The cut is found from counts by day, and ties of that day by case number."""
    by_day = rows.groupBy("filing_date").agg(F.count(F.lit(1)).alias("m"))
    upto = F.sum("m").over(Window.orderBy("filing_date"))
    total = F.sum("m").over(Window.partitionBy(F.lit(1)))
    day = by_day.withColumn("upto", upto).withColumn("want", F.floor(share * total)).where("upto - m < want AND upto >= want").select(F.col("filing_date").alias("day"), (F.col("want") - F.col("upto") + F.col("m")).alias("left"))
    marked = rows.join(day, F.lit(True))
    tied = marked.where("filing_date = day").withColumn("rn", F.row_number().over(Window.partitionBy("day").orderBy("case_id")))
    pick = lambda sides, ties: marked.where(sides).drop("day", "left").unionByName(tied.where(ties).drop("day", "left", "rn"))
    return pick("filing_date < day", "rn <= left"), pick("filing_date > day", "rn > left")


def median_model(train: DataFrame) -> tuple[DataFrame, DataFrame]:
    return train.groupBy("court_level", "case_type").agg(F.median("days").alias("m")), train.agg(F.median("days").alias("overall"))


def predicted(t: Tables) -> DataFrame:
    train, test = split(dataset(t))
    by_group, overall = median_model(train)
    return test.join(by_group, ["court_level", "case_type"], "left").join(overall, F.lit(True)).withColumn("predicted", F.coalesce("m", "overall")).drop("m", "overall")


@query("ml_1_features", "SELECT c.case_id, round(sin(2 * pi() * month(filing_date) / 12), 6) + 0 AS month_sin, round(cos(2 * pi() * month(filing_date) / 12), 6) + 0 AS month_cos, round(ln(1 + count(*) OVER (PARTITION BY court_id ORDER BY filing_date RANGE BETWEEN INTERVAL 90 DAY PRECEDING AND CURRENT ROW)), 6) AS log_backlog FROM cases c")
def features(t: Tables) -> DataFrame:
    angle = 2 * F.pi() * F.month("filing_date") / 12
    return t.cases.join(filing_backlog(t), "case_id").select("case_id", (F.round(F.sin(angle), 6) + 0).alias("month_sin"), (F.round(F.cos(angle), 6) + 0).alias("month_cos"), F.round(F.log1p("backlog"), 6).alias("log_backlog"))


@query("ml_2_dataset", SET_SQL + " SELECT case_id, days FROM ds")
def dataset_query(t: Tables) -> DataFrame:
    return dataset(t).select("case_id", "days")


@query("ml_3_median_model", SET_SQL + " SELECT case_id, predicted FROM pr")
def median_query(t: Tables) -> DataFrame:
    return predicted(t).select("case_id", "predicted")


def ridge(train: DataFrame, test: DataFrame) -> DataFrame:
    """test with a prediction by ridge regression on one-hot and numeric features, fitted on the training rows."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
    from pyspark.ml.regression import LinearRegression

    stages = [StringIndexer(inputCols=KINDS, outputCols=[f"{k}_i" for k in KINDS], handleInvalid="keep"), OneHotEncoder(inputCols=[f"{k}_i" for k in KINDS], outputCols=[f"{k}_v" for k in KINDS]), VectorAssembler(inputCols=[*[f"{k}_v" for k in KINDS], "amount"], outputCol="features")]
    model = Pipeline(stages=[*stages, LinearRegression(labelCol="days", regParam=100.0, elasticNetParam=0.0, solver="normal")]).fit(train)
    return model.transform(test).select(*test.columns, F.greatest(F.lit(1.0), "prediction").alias("predicted"))


def quantile_trees(train: DataFrame, test: DataFrame) -> DataFrame:
    """test with low, median and high by boosted trees for the quantiles 0.1, 0.5 and 0.9, each one day at least."""
    month = lambda df: df.withColumn("month", F.month("filing_date"))
    found = QuantileTrees("days", ["amount", "month"], KINDS).fit(month(train)).predict(month(test)).drop("month")
    return found.select(*test.columns, *[F.greatest(F.lit(1.0), f"q{i}").alias(n) for i, n in enumerate(("low", "median", "high"))])


@query("ml_4_linear_model")
def linear_model(t: Tables) -> DataFrame:
    return ridge(*split(dataset(t))).select("case_id", "predicted")


@query("ml_4_quantile_model")
def quantile_model(t: Tables) -> DataFrame:
    return quantile_trees(*split(dataset(t))).select("case_id", F.round("low", 4).alias("low"), F.round("median", 4).alias("median"), F.round("high", 4).alias("high"))


@query("ml_5_model_choice")
def model_choice(t: Tables) -> DataFrame:
    """Errors of both models on the rows filed last; the one with the smaller mean absolute error is chosen."""
    train, test = (checkpoint(x) for x in split(dataset(t)))
    each = ridge(train, test).select(F.lit("ridge").alias("model"), "days", "predicted").unionByName(quantile_trees(train, test).select(F.lit("trees").alias("model"), "days", F.col("median").alias("predicted")))
    error = F.col("days") - F.col("predicted")
    g = each.groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(error)).alias("mae"), F.sqrt(F.avg(error * error)).alias("rmse"), (1 - F.sum(error * error) / (F.var_pop("days") * F.count(F.lit(1)))).alias("r2"))
    g = checkpoint(g)
    best = g.agg(F.min(F.struct("mae", "model")).alias("b")).select(F.col("b.model").alias("best"))
    return g.join(F.broadcast(best), F.lit(True)).select("model", "n", *[F.round(c, 4).alias(c) for c in ("mae", "rmse", "r2")], (F.col("model") == F.col("best")).alias("chosen"))


@query("ml_6_model_interval")
def model_interval(t: Tables) -> DataFrame:
    """The bounds of the models for the quantiles 0.1 and 0.9, the confidence that their width leaves, and whether the case fell between them."""
    found = quantile_trees(*split(dataset(t)))
    width = (F.col("high") - F.col("low")) / (2 * F.col("median") + 1)
    return found.select("case_id", F.round("low", 4).alias("low"), F.round("high", 4).alias("high"), F.round(clamp(1 - width), 4).alias("confidence"), F.col("days").between(F.col("low"), F.col("high")).alias("inside"))


@query("ml_5_evaluation", SET_SQL + " SELECT count(*) AS n, round(avg(abs(days - predicted)), 4) AS mae, round(sqrt(avg(pow(days - predicted, 2))), 4) AS rmse, median(abs(days - predicted)) AS median_error FROM pr")
def evaluation(t: Tables) -> DataFrame:
    error = F.abs(F.col("days") - F.col("predicted"))
    return predicted(t).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(error), 4).alias("mae"), F.round(F.sqrt(F.avg(error * error)), 4).alias("rmse"), F.median(error).alias("median_error"))


@query("ml_6_interval", SET_SQL + " SELECT case_id, round(greatest(1, predicted) * 0.7, 4) AS low, round(greatest(1, predicted) * 1.5, 4) AS high, round(least(1, greatest(0, 1 - 0.8 * greatest(1, predicted) / (2 * greatest(1, predicted) + 1))), 4) AS confidence FROM pr")
def interval(t: Tables) -> DataFrame:
    p = F.greatest(F.lit(1.0), "predicted")
    return predicted(t).select("case_id", F.round(p * 0.7, 4).alias("low"), F.round(p * 1.5, 4).alias("high"), F.round(clamp(1 - 0.8 * p / (2 * p + 1)), 4).alias("confidence"))


@query("ml_7_ratio", SET_SQL + ", ra AS (SELECT case_id, CASE WHEN predicted <= 0 THEN 0 ELSE round(days / predicted, 4) END AS ratio FROM pr) SELECT case_id, ratio, CASE WHEN ratio >= 3 THEN 'extreme' WHEN ratio >= 2 THEN 'severe' WHEN ratio >= 1.5 THEN 'moderate' ELSE 'normal' END AS severity FROM ra")
def ratio(t: Tables) -> DataFrame:
    r = F.when(F.col("predicted") <= 0, 0.0).otherwise(F.round(F.col("days") / F.col("predicted"), 4))
    label = F.when(F.col("ratio") >= 3, "extreme").when(F.col("ratio") >= 2, "severe").when(F.col("ratio") >= 1.5, "moderate").otherwise("normal")
    return predicted(t).select("case_id", r.alias("ratio")).withColumn("severity", label)
