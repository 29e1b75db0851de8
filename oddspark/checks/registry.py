"""The registered queries: a Spark callable and, where SQL can say it, the same in SQL."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from oddspark.checks import star as S

Query = Callable[[S.Star], DataFrame]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, answers: bool = False):
    """Register a query under its name, with an SQL body over the model's relations."""
    def register(build: Query) -> Query:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return round_doubles(build(S.Star(spark, folder)))

        QUERIES[name] = run
        if sql is not None:
            model = S.MODEL_SQL + ("," + S.ANSWER_SQL if answers else "")
            ORACLES[name] = f"WITH {model}\n{sql}"
        return build

    return register


def round_doubles(df: DataFrame) -> DataFrame:
    """Doubles to six places, so that last digits of two engines compare equal."""
    return df.select(*[
        F.round(f.name, 6).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name)
        for f in df.schema
    ])


def joined(array: str) -> Column:
    """A list of strings as one string, so that lists compare as text."""
    return F.array_join(array, ",")
