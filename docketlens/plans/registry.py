"""The registry of queries: each has a name, a callable over (spark, sf_dir) and, where SQL can say it, DuckDB SQL."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docketlens.sources.domain import VIEWS_SQL, Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers build(tables) -> DataFrame under a name; sql may use the domain views."""

    def keep(build: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: build(Tables(spark, sf_dir))
        if sql:
            ORACLE[name] = f"WITH {VIEWS_SQL}\n{sql}" if not sql.lstrip().startswith(",") else f"WITH {VIEWS_SQL}{sql}"
        return build

    return keep
