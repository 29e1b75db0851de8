"""Quality rules with thresholds that follow each language and source."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oddspark.llm.shared import SPACE, Work, let, same, words

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
#: Per metric, in thousandths: the least threshold. No group's threshold falls below it, so that a
#: source without any symbols doesn't reject the first document that has one.
FLOORS = {"symbol_rate": 60, "repeat_rate": 180, "dup_line_rate": 300, "shout_rate": 250}
#: A group with fewer documents takes the sketch of its language, a small language that of all.
LEAST_GROUP = 50


def covered_by_repeats(tokens: Column, width: int = 5) -> Column:
    """How many words lie in ``width``-word windows that the text holds twice or more.

    Everything stays inside the row. Only a text with a repeated window sorts its windows.
    """
    def windows(h):
        starts = F.sequence(F.lit(0), F.size(h) - width)
        return F.when(F.size(h) >= width, F.transform(
            starts, lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(width)]),
        )).otherwise(F.array().cast("array<bigint>"))

    def covered(g):
        dealt = F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
        at = let(dealt, lambda z: F.transform(
            F.filter(z, lambda e, i: F.coalesce(F.get(z, i - 1)["h"] == e["h"], F.lit(False))
                     | F.coalesce(F.get(z, i + 1)["h"] == e["h"], F.lit(False))),
            lambda e: e["p"]))
        start = F.struct(F.lit(0).alias("n"), F.lit(-width).alias("last"))
        return F.aggregate(F.sort_array(at), start, lambda s, p: F.struct(
            (s["n"] + F.least(F.lit(width), p - s["last"])).alias("n"), p.alias("last")),
            lambda s: s["n"])

    hashes = F.transform(tokens, lambda w: F.xxhash64(w))
    return let(hashes, lambda h: let(windows(h), lambda g: F.when(
        F.size(F.array_distinct(g)) < F.size(g), covered(g)).otherwise(0))).cast("long")


def counted(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, a hash of the row, and the counts of every whole text."""
    text = F.coalesce(docs["text"], F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, " \t\n\x0b\x0c\r", "")) > 0)
    measured = F.struct(
        let(words(text), lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"), covered_by_repeats(w).alias("n_repeat_words"),
        )).alias("w"),
        let(lines, lambda x: F.struct(
            F.size(x).cast("long").alias("n_lines"),
            (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))).alias("l"),
    )
    one = docs.select(
        "doc_id", "lang", "source", F.xxhash64("text", "lang", "source").alias("row_hash"),
        F.length(F.regexp_replace(text, SPACE, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.length(text) - F.length(F.translate(text, "!", ""))).cast("long").alias("n_shouts"),
        F.explode(F.array(measured)).alias("m"))
    return one.select(
        "doc_id", "lang", "source", "row_hash", "m.w.n_words", "word_chars", "n_symbols",
        "m.l.n_dup_lines", "m.w.n_repeat_words", "m.l.n_lines", "n_shouts")


def rates() -> dict[str, Column]:
    """Thousandths, whole numbers, so that every engine gets the same."""
    share = lambda a, b: F.coalesce(F.expr(f"1000 * {a} div nullif({b}, 0)"), F.lit(0))
    return {"symbol_rate": share("n_symbols", "word_chars"),
            "repeat_rate": share("n_repeat_words", "n_words"),
            "dup_line_rate": share("n_dup_lines", "n_lines"),
            "shout_rate": share("n_shouts", "n_words")}


def sketched(counts: DataFrame) -> DataFrame:
    """The quantile sketch: documents by language, source, metric and bucket.

    A bucket keeps two leading digits of a value, so a sketch has some hundred buckets at most,
    quantiles are right to a tenth, and two sketches merge by adding their counts.
    """
    values = F.explode(F.array(*[
        F.struct(F.lit(name).alias("metric"), rate.alias("v")) for name, rate in rates().items()]))
    unit = F.pow(F.lit(10), F.greatest(F.length(F.col("v").cast("string")) - 2, F.lit(0))).cast("long")
    return (counts.select("lang", "source", values.alias("x")).select("lang", "source", "x.*")
            .withColumn("bucket", F.col("v") - F.col("v") % unit)
            .groupBy("lang", "source", "metric", "bucket").agg(F.count("*").alias("n")))


def thresholds(sketch: DataFrame, least_group: int) -> DataFrame:
    """(lang, source) -> a threshold per metric: upper quartile and three quartile distances."""
    own = (sketch.groupBy("lang", "source", "metric", "bucket").agg(F.sum("n").alias("n"))
           .withColumn("level", F.lit(0)))
    by_lang = (sketch.groupBy("lang", "metric", "bucket").agg(F.sum("n").alias("n"))
               .selectExpr("lang", "string(null) source", "metric", "bucket", "n", "1 level"))
    by_all = (sketch.groupBy("metric", "bucket").agg(F.sum("n").alias("n"))
              .selectExpr("string(null) lang", "string(null) source", "metric", "bucket", "n", "2 level"))
    group = ["level", "lang", "source", "metric"]
    up_to = Window.partitionBy(*group).orderBy("bucket")
    merged = (own.unionByName(by_lang).unionByName(by_all)
              .withColumn("below", F.sum("n").over(up_to))
              .withColumn("docs", F.sum("n").over(Window.partitionBy(*group))))
    at = lambda pct: F.min(F.when(F.col("below") * 100 >= pct * F.col("docs"), F.col("bucket")))
    quartiles = merged.groupBy(*group).agg(
        at(25).alias("q1"), at(75).alias("q3"), F.max("docs").alias("docs"))
    fence = F.col("q3") + 3 * (F.col("q3") - F.col("q1"))
    fences = quartiles.groupBy("level", "lang", "source").agg(F.max("docs").alias("docs"), *[
        F.max(F.when(F.col("metric") == name, F.greatest(fence, F.lit(floor)))).alias(f"max_{name}")
        for name, floor in FLOORS.items()])
    o, b, a = (fences.where(F.col("level") == k).alias(x) for k, x in enumerate("oba"))
    pick = [F.when(F.col("o.docs") >= least_group, F.col(f"o.max_{n}"))
            .when(F.col("b.docs") >= least_group, F.col(f"b.max_{n}"))
            .otherwise(F.col(f"a.max_{n}")).alias(f"max_{n}") for n in FLOORS]
    # One row of all documents meets every group.
    return (o.join(b, F.col("o.lang").eqNullSafe(F.col("b.lang")))
            .join(F.broadcast(a), F.lit(True)).select("o.lang", "o.source", *pick))


def quality_rules(docs: DataFrame, least_group: int = LEAST_GROUP, work: Work | None = None) -> DataFrame:
    """Counts and verdict per document (doc_id, text, lang, source; other columns are not read).

    Fixed base rules fail short and repetitive texts. Beyond them a document is rejected if its
    rate of symbols, repeated words, repeated lines or exclamation marks exceeds the threshold of
    its language and source. The thresholds come from mergeable quantile sketches over all
    documents and are joined back.

    Null or empty texts have no words and fail. A null language or source is a group like any
    other. Texts of any length are counted whole. Values equal to a threshold pass. Repeated rows
    are judged alike, each for itself; an empty table gives an empty one.
    """
    work = work or Work(docs.sparkSession, "quality")
    counts = work.store(counted(docs), "counts")
    limits = thresholds(work.store(sketched(counts), "sketch"), least_group)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    within = F.lit(True)
    for name, rate in rates().items():
        within = within & (rate <= F.col(f"max_{name}"))
    return (counts.alias("c").join(limits.alias("t"), same("c", "t", "lang", "source"), "left")
            .select("c.*", *[f"max_{n}" for n in FLOORS], failed.alias("base_failed"),
                    (~failed & F.coalesce(within, F.lit(False))).alias("kept")))


def keep_good(docs: DataFrame, least_group: int = LEAST_GROUP) -> DataFrame:
    """The documents that the rules keep, all columns. Texts move once, to meet their verdicts."""
    verdicts = quality_rules(docs, least_group).where("kept").select("doc_id", "row_hash").distinct()
    on = (F.col("d.doc_id").eqNullSafe(F.col("v.doc_id"))
          & (F.xxhash64("d.text", "d.lang", "d.source") == F.col("v.row_hash")))
    return docs.alias("d").join(verdicts.alias("v").hint("merge"), on, "left_semi")
