"""Tables stored by report: joins and counts by report read them without a shuffle."""

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oddspark.workspace import delete_folder, stored_values

KEY = "primaryid"


def write_by_report(df: DataFrame, table: str, path: str, buckets: int, key: str = KEY) -> DataFrame:
    """Store ``df`` below ``path`` in ``buckets`` buckets of ``key``, sorted, and return the stored table.

    ``table`` is its name in the session's catalog; it must be new, as must the path. Tables that are to
    be joined without a shuffle need the same number of buckets and a key of the same type. Choose
    it so that a bucket of the largest table is about 200 MB. The rows are gathered by key first, so
    that a bucket is few files; the files of a very full one are written by several tasks.
    """
    (
        df.hint("rebalance", buckets, key)
        .write.format("parquet")
        .bucketBy(buckets, key)
        .sortBy(key)
        .option("path", f"{path}/buckets={buckets}")
        .saveAsTable(table)
    )
    return df.sparkSession.table(table)


def table_at(path: str) -> str:
    """The name in the session's catalog of the table that ``keep_by_report`` stores at ``path``."""
    return "by_report_" + hashlib.sha256(path.rstrip("/").encode()).hexdigest()[:32]


def keep_by_report(df: DataFrame, path: str, key: list[str], gather: bool = False) -> DataFrame:
    """Store ``df`` at ``path`` in as many buckets of ``key`` as the session has shuffle partitions, and read it back.

    Rows that come from a join or count by ``key`` lie by it already, and are written as they lie; any others
    need ``gather``. What is at the path is replaced. Readers by path see plain Parquet.
    """
    spark = df.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = df.hint("rebalance", buckets, *key) if gather else df
    (
        rows.write.mode("overwrite").format("parquet").bucketBy(buckets, *key)
        .option("path", path).saveAsTable(table_at(path))
    )
    return spark.table(table_at(path))


def read_kept(spark: SparkSession, path: str) -> DataFrame:
    """The table at ``path``, by its buckets where this session has stored it."""
    return spark.table(table_at(path)) if spark.catalog.tableExists(table_at(path)) else spark.read.parquet(path)


def drop_kept(spark: SparkSession, path: str) -> None:
    """Delete a table of ``keep_by_report`` that nothing reads any more."""
    spark.sql(f"DROP TABLE IF EXISTS {table_at(path)}")
    delete_folder(spark, path)


def open_by_report(spark: SparkSession, table: str, path: str, key: str = KEY) -> DataFrame:
    """The table that ``write_by_report`` stored below ``path``, also in another session.

    The number of buckets comes from the folder's name, so it cannot differ from the files.
    """
    if not spark.catalog.tableExists(table):
        found = stored_values(spark, path, "buckets")
        if len(found) != 1:
            raise ValueError(f"{path} holds {len(found)} bucketed tables")
        [(buckets, folder)] = found.items()
        columns = ", ".join(
            f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(folder).schema)
        spark.sql(
            f"CREATE TABLE {table} ({columns}) USING parquet "
            f"CLUSTERED BY (`{key}`) SORTED BY (`{key}`) INTO {int(buckets)} BUCKETS LOCATION '{folder}'")
    return spark.table(table)


def rows_per_report(reports: DataFrame, children: dict[str, DataFrame], key: str = KEY) -> DataFrame:
    """``key`` and the number of rows in every child table, 0 included, for the given reports.

    Rows are counted before the join. On tables stored by report neither step shuffles. Child rows
    of other reports, or without a key, don't count; a report listed twice is one row.
    """
    counted = reports.filter(F.col(key).isNotNull()).select(key).distinct()
    for name, child in children.items():
        rows = child.groupBy(key).agg(F.count(F.lit(1)).alias(name))
        counted = counted.join(rows, key, "left")
    return counted.fillna(0, list(children))
