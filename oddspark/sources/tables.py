"""Parquet tables: store by quarter, read with pruning, append, replace, merge and publish."""

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from oddspark import fixed_values as V
from oddspark.functions.demographics import all_of, any_of
from oddspark.operators.upsert import new_rows, upsert_by_key
from oddspark.workspace import delete_folder, local_table, new_folder, stored


def write_parquet(df: DataFrame, path: str) -> None:
    """Snappy Parquet by quarter. Only the quarters present in ``df`` are replaced."""
    (
        df.write.mode("overwrite")
        .option("compression", "snappy")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("faers_quarter")
        .parquet(path)
    )


def scan_parquet(
    spark: SparkSession,
    root: str,
    tables: list[str] = V.DETAIL_TABLES,
    quarters: list[str] | None = None,
) -> dict[str, DataFrame]:
    """The stored tables, restricted to some quarters by partition pruning."""
    chosen = all_of(any_of(F.col("faers_quarter"), quarters))
    return {t: spark.read.parquet(f"{root}/{t}").filter(chosen) for t in tables}


def append_table(df: DataFrame, path: str, columns: list[str]) -> None:
    """Append the chosen columns in the chosen order; empty strings become null."""
    strings = {f.name for f in df.schema if isinstance(f.dataType, T.StringType)}
    chosen = [
        F.nullif(F.col(c), F.lit("")).alias(c) if c in strings else F.col(c) for c in columns
    ]
    df.select(*chosen).write.mode("append").parquet(path)


def overwrite_table(df: DataFrame, path: str) -> None:
    """Replace the whole table, so that a second run changes nothing."""
    df.write.mode("overwrite").parquet(path)


def read_if_exists(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The stored table, or an empty one."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def insert_ignore_table(incoming: DataFrame, path: str, key: list[str]) -> None:
    """Append the rows whose key is not stored yet. Safe to repeat."""
    existing = read_if_exists(incoming.sparkSession, path, incoming.schema)
    new_rows(existing, incoming, key).select(*incoming.columns).write.mode("append").parquet(path)


def upsert_table(incoming: DataFrame, path: str, out_path: str, key: list[str]) -> None:
    """Write the merged table to ``out_path``, beside the one at ``path``.

    The stored table is only read, so a failed run leaves it whole; the caller then points its
    readers at the new path.
    """
    if path.rstrip("/") == out_path.rstrip("/"):
        raise ValueError("write the merged table beside the stored one")
    existing = read_if_exists(incoming.sparkSession, path, incoming.schema)
    overwrite_table(upsert_by_key(existing, incoming, key), out_path)


def publish_reconciled(
    tables: dict[str, DataFrame],
    target: str,
    columns: dict[str, list[str]] = V.PUBLISHED_TABLES,
) -> DataFrame:
    """Copy the listed columns of the listed tables, in order, then compare row counts.

    Every source is computed once, into the shared folder, and its rows are counted on the way; the
    target's are counted as they lie there. An empty source is skipped and leaves the target as it is. Returns
    ``table_name, n_source, n_target, status`` with status OK, WARNING or SKIPPED. Tables without
    listed columns are refused before anything is written.
    """
    unknown = sorted(set(tables) - set(columns))
    if unknown:
        raise ValueError(f"no columns are listed for {', '.join(unknown)}")
    if not tables:
        raise ValueError("no tables to publish")
    report = []
    for table in [t for t in columns if t in tables]:
        source, path, seen = tables[table].select(*columns[table]), f"{target}/{table}", Observation()
        spark, draft = source.sparkSession, new_folder(source.sparkSession, table)
        staged = stored(source.observe(seen, F.count(F.lit(1)).alias("n_source")), draft)
        n_source = seen.get["n_source"]
        if n_source:
            overwrite_table(staged, path)
        n_target = read_if_exists(spark, path, source.schema).count()
        delete_folder(spark, draft)
        status = "SKIPPED" if not n_source else "OK" if n_source == n_target else "WARNING"
        report.append({"table_name": table, "n_source": n_source, "n_target": n_target, "status": status})
    return local_table(spark, report, "table_name string, n_source long, n_target long, status string")


def rows_to_json(df: DataFrame, name: str = "json") -> DataFrame:
    """Every row as a JSON object with its nulls; dates, times and decimals as text."""
    textual = (T.DateType, T.TimestampType, T.TimestampNTZType, T.DecimalType)
    columns = [
        F.col(f.name).cast("string").alias(f.name)
        if isinstance(f.dataType, textual)
        else F.col(f.name)
        for f in df.schema
    ]
    return df.select(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias(name))


def json_report_sink(df: DataFrame, path: str) -> None:
    """Store a report as JSON lines."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)
