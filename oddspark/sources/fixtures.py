"""Curated inputs: the class dictionary, known signals and answer rules."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from oddspark import fixed_values as V
from oddspark import schemas
from oddspark.workspace import local_table


def inline_dictionary(spark: SparkSession, members: list[tuple] = V.CLASS_DICTIONARY) -> DataFrame:
    """The dictionary of a drug class, in its given order."""
    rows = [
        dict(zip(schemas.DICTIONARY.names, (i, *member))) for i, member in enumerate(members)
    ]
    return local_table(spark, rows, schemas.DICTIONARY)


def list_dictionary(dictionary: DataFrame) -> DataFrame:
    """The members of the class by name."""
    return dictionary.select("active_ingredient").orderBy("active_ingredient")


def load_fixture(spark: SparkSession, source: str | list[dict], schema: T.StructType) -> DataFrame:
    """Nested records from JSON lines or from a list of dictionaries; missing fields are null."""
    if isinstance(source, str):
        return spark.read.schema(schema).json(source)
    return local_table(spark, source, schema)


def known_signals(spark: SparkSession) -> DataFrame:
    """The signals known from the literature for the target class."""
    names = ["id", "drug", "event_pts", "literature_source", "year"]
    records = [dict(zip(names, row)) for row in V.KNOWN_SIGNALS]
    return load_fixture(spark, records, schemas.KNOWN_SIGNALS)
