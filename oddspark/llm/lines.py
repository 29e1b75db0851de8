"""Removal of repeated multi-line chunks whose boundaries depend on content."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oddspark.llm.shared import Work, free_name, let, same

#: Lines that a boundary looks back on, itself included; one position in so many is a boundary.
WINDOW, ONE_IN = 2, 3
BASE, PRIME = 1_000_003, 2_147_483_647


def line_hash(line: Column) -> Column:
    return F.conv(F.substring(F.md5(line.cast("binary")), 1, 8), 16, 10).cast("long")


def rolled(hashes: Column, i: Column, window: int) -> Column:
    """The hash of the ``window`` lines that end at line ``i``; null for the first lines."""
    value = F.lit(0).cast("long")
    for back in reversed(range(window)):
        value = (value * BASE + F.get(hashes, i - back)) % PRIME
    return value


def chunk_rows(docs: DataFrame, window: int, one_in: int) -> DataFrame:
    """(doc_id, row_hash, first, n, chunk) for every chunk of two lines or more with content.

    A chunk ends after each line where the rolling hash says so, and with the text.
    """
    def cut(lines):
        n = F.size(lines)
        return let(F.transform(lines, line_hash), lambda h: let(
            F.concat(F.array(F.lit(0)),
                     F.filter(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: (i < n) & (
                         F.coalesce(rolled(h, i - 1, window) % one_in == 0, F.lit(False)))),
                     F.array(n)),
            lambda at: F.filter(F.transform(at, lambda a, k: F.struct(
                a.alias("first"), (F.get(at, k + 1) - a).alias("n"))), lambda c: c["n"] >= 2)))

    def texts(lines):
        return F.transform(cut(lines), lambda c: F.struct(
            c["first"].alias("first"), c["n"].alias("n"),
            F.array_join(F.slice(lines, c["first"] + 1, c["n"]), "\n").alias("chunk")))

    rows = docs.where("text is not null").select(
        "doc_id", F.xxhash64("text").alias("row_hash"),
        F.explode(let(F.split("text", "\n"), texts)).alias("c"))
    return rows.select("doc_id", "row_hash", "c.*").where(F.length(F.trim("chunk")) > 0)


def removed_chunks(docs: DataFrame, window: int, one_in: int, work: Work) -> DataFrame:
    """(doc_id, row_hash, gone): the chunks of each text, as (first, n), of which an earlier copy exists."""
    chunks = chunk_rows(docs, window, one_in).withColumn("hash", F.xxhash64("chunk"))
    # Joins that move texts are always sort-merge joins: nothing is broadcast on a size that grows,
    # skewed keys are split, and the plan is the same at every size.
    often = work.store(chunks.groupBy("hash").agg(F.count("*").alias("n"))
                       .where("n > 1").select("hash"), "repeated-hashes")
    copies = work.store(chunks.join(often.hint("merge"), "hash", "left_semi"), "candidates")
    where = F.struct("doc_id", "row_hash", "first")
    groups = (copies.groupBy("hash", "chunk").agg(F.count("*").alias("copies"), F.min(where).alias("kept"))
              .where("copies > 1"))
    groups = work.store(groups, "groups")
    later = copies.alias("c").join(groups.alias("g").hint("merge"), same("c", "g", "hash", "chunk")).where(
        ~F.struct("c.doc_id", "c.row_hash", "c.first").eqNullSafe(F.col("g.kept")))
    gone = later.groupBy("c.doc_id", "c.row_hash").agg(
        F.collect_set(F.struct("c.first", "c.n")).alias("gone"))
    gone = work.store(gone, "gone")
    work.drop("repeated-hashes", "candidates", "groups")
    return gone


def dedup_lines(docs: DataFrame, window: int = WINDOW, one_in: int = ONE_IN) -> DataFrame:
    """``docs`` (doc_id, text and any others) without repeated chunks; adds n_lines and n_removed.

    A text is cut into chunks of lines where a rolling hash over the last lines' hashes is a
    multiple of ``one_in``, so that inserted lines move boundaries only nearby. Of chunks of two or
    more lines that are equal byte for byte, in one text or in several, the first by doc_id, text
    hash and line stays, the others go. Chunks of white space only are left alone.

    A null text stays null, with no lines; an empty one has one line. Rows equal in doc_id and text
    count as one document and get the same result. Existing columns n_lines and n_removed keep
    their names, the new ones get an underscore in front. Texts of any length are cut whole. An empty
    table gives an empty one.
    """
    return without(docs, removed_chunks(docs, window, one_in, Work(docs.sparkSession, "lines")))


def window_rows(docs: DataFrame, known: str | None = None) -> DataFrame:
    """(doc_id, row_hash, first, hash, chunk) for every two adjacent lines with content; not those within a chunk that
    the column ``known`` lists as (first, n)."""
    def pairs(lines):
        firsts = F.sequence(F.lit(0), F.size(lines) - 2)
        if known:
            within = F.flatten(F.transform(known, lambda c: F.sequence(c["first"], c["first"] + c["n"] - 2)))
            firsts = F.when(F.col(known).isNull(), firsts).otherwise(F.array_except(firsts, within))
        return F.when(F.size(lines) >= 2, F.transform(firsts, lambda i: F.struct(
            i.alias("first"), F.concat(F.get(lines, i), F.lit("\n"), F.get(lines, i + 1)).alias("chunk"))))

    rows = docs.where("text is not null").select(
        "doc_id", F.xxhash64("text").alias("row_hash"), F.explode(let(F.split("text", "\n"), pairs)).alias("c"))
    return (rows.select("doc_id", "row_hash", "c.*").where(F.length(F.trim("chunk")) > 1)
            .withColumn("hash", F.xxhash64("chunk")))


def repeated_passages(docs: DataFrame, work: Work, known: str | None = None) -> DataFrame:
    """(doc_id, row_hash, gone): the runs of lines of each text, as (first, n), that repeat earlier ones.

    Two-line windows are posted by hash; those with an earlier copy, byte for byte, that they don't
    overlap join to maximal runs. Chunks in the column ``known`` repeat: the windows within them aren't
    looked at, and the others find all they would, as the first place of a window is in no such chunk.
    """
    where = F.struct("doc_id", "row_hash", "first")
    posted = window_rows(docs, known)
    often = (posted.groupBy("hash").agg(F.min(where).alias("a"), F.max(where).alias("z"))
             .where("not a <=> z").select("hash"))
    often = work.store(often, "repeated-hashes")
    copies = work.store(posted.join(often.hint("merge"), "hash", "left_semi"), "candidates")
    groups = (copies.groupBy("hash", "chunk").agg(F.min(where).alias("kept"), F.max(where).alias("z"))
              .where("not kept <=> z").drop("z"))
    groups = work.store(groups, "groups")
    later = copies.alias("c").join(groups.alias("g").hint("merge"), same("c", "g", "hash", "chunk")).where(
        ~(F.struct("c.doc_id", "c.row_hash").eqNullSafe(F.struct("g.kept.doc_id", "g.kept.row_hash"))
          & (F.col("c.first") <= F.col("g.kept.first") + 1)))

    def runs(firsts):
        begin = F.sort_array(F.array_except(firsts, F.transform(firsts, lambda i: i + 1)))
        end = F.sort_array(F.array_except(firsts, F.transform(firsts, lambda i: i - 1)))
        return F.zip_with(begin, end, lambda a, z: F.struct(a.alias("first"), (z - a + 2).alias("n")))

    gone = later.groupBy("c.doc_id", "c.row_hash").agg(F.collect_set("c.first").alias("firsts"))
    gone = work.store(gone.select("doc_id", "row_hash", let(F.col("firsts"), runs).alias("gone")), "gone")
    work.drop("repeated-hashes", "candidates", "groups")
    return gone


def dedup_passages(docs: DataFrame) -> DataFrame:
    """``docs`` without repeated passages; columns, nulls and equal rows as in ``dedup_lines``.

    A passage is a run of two or more lines, wherever it begins and ends. Every two adjacent lines
    that stand at an earlier place too, by doc_id, text hash and line, go from the later one, so
    passages go up to their last line that is equal. A window that overlaps its own first copy stays.
    Windows of white space only are left alone. The first place of every line stays.
    """
    return without(docs, repeated_passages(docs, Work(docs.sparkSession, "passages")))


def gone_from(docs: str, gone: str) -> Column:
    """Whether a row of the alias ``gone`` is of this row's doc_id and text."""
    return (F.col(f"{docs}.doc_id").eqNullSafe(F.col(f"{gone}.doc_id"))
            & (F.xxhash64(f"{docs}.text") == F.col(f"{gone}.row_hash")))


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` without the lines of ``gone``; adds n_lines and n_removed."""
    n_lines, n_removed = free_name(docs, "n_lines"), free_name(docs, "n_removed")
    gone_lines = F.flatten(F.transform("g.gone", lambda c: F.sequence(c["first"], c["first"] + c["n"] - 1)))
    kept = F.when(F.col("g.gone").isNull(), F.col("d.text")).otherwise(let(
        F.split("d.text", "\n"), lambda lines: F.array_join(F.transform(
            F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone_lines),
            lambda i: F.get(lines, i)), "\n")))
    lines = F.when(F.col("d.text").isNull(), 0).otherwise(
        F.length("d.text") - F.length(F.translate("d.text", "\n", "")) + 1)
    return docs.alias("d").join(gone.alias("g").hint("merge"), gone_from("d", "g"), "left").select(
        *[kept.alias(c) if c.lower() == "text" else F.col(f"d.`{c}`") for c in docs.columns],
        lines.cast("long").alias(n_lines),
        F.coalesce(F.aggregate("g.gone", F.lit(0), lambda s, c: s + c["n"]), F.lit(0))
        .cast("long").alias(n_removed))


def found_by_both(docs: DataFrame, window: int, one_in: int, work: Work) -> DataFrame:
    """(doc_id, row_hash, gone): the chunks of each text that repeat, then the passages that chunk boundaries cut.

    Places are those in the whole text for both, so runs of the two may overlap by a line.
    """
    chunks = removed_chunks(docs, window, one_in, work)
    texts = docs.select("doc_id", "text").alias("d").join(
        chunks.alias("g").hint("merge"), gone_from("d", "g"), "left").select("d.doc_id", "d.text", "g.gone")
    rest = repeated_passages(texts, Work(work.spark, "passages"), "gone")
    runs = chunks.unionByName(rest.select("doc_id", "row_hash", F.col("gone").cast(chunks.schema["gone"].dataType)))
    lines = F.array_sort(F.array_distinct(F.flatten(F.transform(
        F.flatten(F.collect_list("gone")), lambda c: F.sequence(c["first"], c["first"] + c["n"] - 1)))))
    return runs.groupBy("doc_id", "row_hash").agg(
        F.transform(lines, lambda i: F.struct(i.alias("first"), F.lit(1).alias("n"))).alias("gone"))


def dedup_chunks_and_passages(docs: DataFrame, window: int = WINDOW, one_in: int = ONE_IN) -> DataFrame:
    """``docs`` without repeated chunks, as ``dedup_lines``, nor the passages that the cuts of chunks miss.

    The content-defined chunks of ``dedup_lines`` go first. What their boundaries cut, a passage whose ends lie within
    chunks, is found by the windows of ``dedup_passages`` outside of those chunks. Both
    judge the whole text. Columns, nulls and equal rows as in ``dedup_lines``.
    """
    return without(docs, found_by_both(docs, window, one_in, Work(docs.sparkSession, "lines")))


def cleaned(docs: DataFrame) -> DataFrame:
    """``docs`` with the same columns: texts without repeated chunks and passages, n_chars counted anew if there."""
    done = dedup_chunks_and_passages(docs)
    return done.select(*[
        F.length("text").cast(docs.schema[c].dataType).alias(c) if c.lower() == "n_chars" else F.col(f"`{c}`")
        for c in docs.columns])
