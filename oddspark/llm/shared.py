"""Helpers of this folder: stored intermediates, words, row keys, connected components."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from oddspark.workspace import new_folder

#: The white space that parts words.
SPACE = r"[\x20\x09-\x0D]+"


class Work:
    """Intermediate tables of one run, in a folder of its own below the shared folder.

    Stored tables cut the lineage: they survive lost executors, and a rerun of a later step reads
    them instead of repeating the earlier ones.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = new_folder(spark, name)

    def store(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{self.path}/{name}")
        return self.read(name, df.schema)

    def read(self, name: str, schema) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def drop(self, *names: str) -> None:
        """Delete tables that no later step reads."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
            path.getFileSystem(conf).delete(path, True)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """The words of a text; none for a null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def same(left: str, right: str, *names: str) -> Column:
    """Equality of all named columns of two aliases, nulls equal to nulls."""
    tests = [F.col(f"{left}.{n}").eqNullSafe(F.col(f"{right}.{n}")) for n in names]
    joined = tests[0]
    for test in tests[1:]:
        joined = joined & test
    return joined


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, with underscores in front until no column of ``df`` has that name."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = "_" + wanted
    return wanted


def components(work: Work, links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b): the smallest node reachable from it.

    Every round a node takes the smallest label among its neighbours, then the label of its label,
    so that long chains halve. Each round is stored; the driver sees one count a round.
    """
    work = Work(work.spark, "components")
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = work.store(both.where("a <> b").distinct(), "links-both-ways")
    labels = both.groupBy("a").agg(F.min("b").alias("m")).select(
        F.col("a").alias("node"), F.least("a", "m").alias("component"))
    labels, turn = work.store(labels, "labels-0"), 0
    while True:
        turn += 1
        heard = (both.join(labels, both.b == labels.node).groupBy("a")
                 .agg(F.min("component").alias("heard")))
        near = (labels.join(heard, labels.node == heard.a)
                .select("node", F.col("component").alias("was"),
                        F.least("component", "heard").alias("component")))
        top = labels.select(F.col("node").alias("t"), F.col("component").alias("above"))
        new = near.join(top, near.component == top.t).select(
            "node", "was", F.least("component", "above").alias("component"))
        new = work.store(new, f"labels-{turn}")
        changed = new.where("component < was").limit(1).count()
        work.drop(f"labels-{turn - 1}")
        labels = new.select("node", "component")
        if not changed:
            return labels


def numbered(work: Work, df: DataFrame, name: str, *order: Column) -> DataFrame:
    """``df`` with ``number``, its place from 0 in the given order, without one task seeing all rows.

    Rows are dealt by range and sorted per partition; a table with one row per partition, so of
    bounded size, holds how many rows lie before each.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    dealt = work.store(dealt.withColumn("slot", F.monotonically_increasing_id()), name)
    part = F.shiftright("slot", 33)
    sizes = dealt.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    before = sizes.withColumn("before", F.coalesce(
        F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return (dealt.withColumn("part", part).join(F.broadcast(before.select("part", "before")), "part")
            .withColumn("number", F.col("before") + F.col("slot").bitwiseAND((1 << 33) - 1))
            .drop("part", "slot", "before"))
