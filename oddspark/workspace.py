"""Written intermediate tables in the shared folder, and small tables from the caller."""

import tempfile
import uuid
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    A session in local mode without that setting gets a fresh local folder; on a cluster, a
    ``local-cluster`` included, the setting is required, because a machine-local folder would not be seen by other machines.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if context.master != "local" and not context.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        folder = tempfile.mkdtemp(prefix="oddspark-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that no other run uses."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Used where several results read one expensive intermediate. The written table survives the
    loss of executors, and Parquet keeps column pruning for the readers.
    """
    return stored(df, new_folder(df.sparkSession, name))


def stored(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` to a new folder and read it back."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _on_disk(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder


def delete_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder that nothing reads any more."""
    files, folder = _on_disk(spark, path)
    files.delete(folder, True)


def stored_values(spark: SparkSession, path: str, column: str) -> dict[str, str]:
    """The values of a table's partition column and their folders; none if there is no table."""
    files, folder = _on_disk(spark, path)
    if not files.exists(folder):
        return {}
    found = {}
    for status in files.listStatus(folder):
        name, _, value = status.getPath().getName().partition("=")
        if name == column:
            found[unquote(value)] = status.getPath().toString()
    return found


def files_below(spark: SparkSession, path: str) -> list[str]:
    """The paths of all files below a folder, but for hidden ones. The driver sees names, never contents."""
    files, folder = _on_disk(spark, path)
    found, walk = [], files.listFiles(folder, True)
    depth = len(files.makeQualified(folder).toString().rstrip("/").split("/"))
    while walk.hasNext():
        name = walk.next().getPath().toString()
        if not any(part.startswith(("_", ".")) for part in name.split("/")[depth:]):
            found.append(name)
    return sorted(found)


def first_line(spark: SparkSession, path: str) -> str | None:
    """The first line of a text file, compressed or not; None if it is empty. Nothing behind it is read."""
    files, file = _on_disk(spark, path)
    io, hadoop = spark._jvm.java.io, spark._jvm.org.apache.hadoop.io.compress
    stream = files.open(file)
    try:
        codec = hadoop.CompressionCodecFactory(spark._jsc.hadoopConfiguration()).getCodec(file)
        source = codec.createInputStream(stream) if codec else stream
        return io.BufferedReader(io.InputStreamReader(source, "UTF-8")).readLine()
    finally:
        stream.close()


def local_table(spark: SparkSession, records: list[dict], schema: T.StructType | str) -> DataFrame:
    """A table of records that the caller holds; missing fields are null.

    Built from Arrow, so that its size is known to the planner, which broadcasts it only below
    its own threshold.
    """
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    complete = [{name: record.get(name) for name in schema.names} for record in records]
    empty = [dict.fromkeys(schema.names)]
    table = pa.Table.from_pylist(complete) if complete else pa.Table.from_pylist(empty).slice(0, 0)
    return spark.createDataFrame(table, schema)
