"""Mixing sources to target weights by highest quotients."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oddspark.llm.shared import Work, free_name, numbered, same

#: Words of a block. Every block costs the same nothing, as no block becomes a row; small ones
#: bring each source closer to its target.
BLOCK_WORDS = 8
#: Words and rows of a shard, about. A source of any size is split into so many more shards.
SHARD_WORDS = 500_000
SHARD_ROWS = 200_000
#: Words and rows of equal rows that lie in one place; more of them are dealt anew.
PIECE_WORDS = 50_000
PIECE_ROWS = 10_000
WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3


def seeded(*parts: Column) -> Column:
    """A number below 2 ** 32 that depends on the parts alone."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 8), 16, 10).cast("long")


def with_targets(work: Work, sources: DataFrame, weights, share: float, most: int) -> DataFrame:
    """source -> party, weight, target: shares by weight, none above ``most`` times its words.

    A source whose share exceeds that stops there, and the rest is shared anew among the others.
    The level (words per unit of weight) only rises, so a round is one small aggregate.
    """
    placed = numbered(work, sources, "sources-in-order", F.col("source").asc_nulls_last())
    listed = F.array(*map(F.lit, weights))
    placed = placed.withColumnRenamed("number", "party")
    placed = work.store(placed.withColumn(
        "weight", F.get(listed, (F.col("party") % len(weights)).cast("int"))), "sources")
    wanted = placed.agg(F.sum("source_size")).first()[0] or 0
    level, capped = 0.0, -1
    while True:
        full = F.col("weight") * F.lit(level) > most * F.col("source_size")
        now, words, rest = placed.agg(
            F.count(F.when(full, 1)), F.coalesce(F.sum(F.when(full, most * F.col("source_size"))), F.lit(0)),
            F.sum(F.when(~full, F.col("weight")))).first()
        if now == capped or not rest:
            break
        level, capped = (wanted * share - words) / rest, now
    target = F.least(F.col("weight") * F.lit(level), (most * F.col("source_size")).cast("double"))
    return placed.withColumn("target", target)


def apportioned(work: Work, df: DataFrame, name: str, group: list[str], key: list[str],
                ideal: str, total: str) -> DataFrame:
    """Sainte-Lague: ``df`` with whole ``seats`` that add up to ``total`` in every group.

    A party with s seats claims the next with share / (2 s + 1); the highest claims win. Rounding
    each share gives the seats for the divisor total / seats. To reach the exact total, a missing
    seat goes to the highest open claim, one too many is taken from the lowest claim met. That
    moves a party by its part of half the number of parties, plus one, at most, so only so many
    of its claims need ranking. Ties go by the key.
    """
    rounded = F.floor(F.col(ideal) + 0.5)
    groups = df.groupBy(*group).agg(
        F.count("*").alias("parties"), F.max(total).alias("total"), F.sum(rounded).alias("met"))
    groups = work.store(groups, f"{name}-groups").withColumn(
        "short", F.coalesce(F.col("total") - F.col("met"), F.lit(0)))
    base = df.drop("total").join(groups, group) if group else df.drop("total").crossJoin(groups)
    reach = F.ceil(F.col(ideal) * F.col("parties") / (2 * F.greatest("total", F.lit(1)))) + 1
    base = work.store(base.withColumn("seats", rounded).withColumn("reach", reach), f"{name}-rounded")
    step = F.explode(F.sequence(F.lit(0), F.col("reach").cast("int")))
    claims = (base.where("short <> 0").withColumn("step", step)
              .withColumn("seat", F.when(F.col("short") > 0, F.col("seats") + F.col("step"))
                          .otherwise(F.col("seats") - 1 - F.col("step")))
              .where((F.col("seat") >= 0) & (F.col(ideal) > 0))
              .withColumn("claim", F.col(ideal) / (2 * F.col("seat") + 1))
              .withColumn("order", F.when(F.col("short") > 0, -F.col("claim")).otherwise(F.col("claim")))
              .select(*group, *key, "short", "step", "order"))
    claims = numbered(work, claims, f"{name}-claims", *map(F.col, [*group, "order", *key, "step"]))
    first = claims.groupBy(*group).agg(F.min("number").alias("first"))
    claims = claims.join(first, group) if group else claims.crossJoin(first)
    moved = (claims.where(F.col("number") - F.col("first") < F.abs("short")).groupBy(*group, *key)
             .agg(F.sum(F.signum("short")).cast("long").alias("moved")))
    return (base.alias("p").join(moved.alias("m"), same("p", "m", *group, *key), "left")
            .select("p.*", (F.col("seats") + F.coalesce("moved", F.lit(0))).alias("won"))
            .drop("seats", "reach", "short", "parties", "met").withColumnRenamed("won", "seats"))


def placed_pieces(work: Work, sized: DataFrame, seed: str, piece_words: int, piece_rows: int) -> DataFrame:
    """Equal rows of ``sized`` as pieces of ``n`` rows, each with its place, hexadecimal digits of a seeded hash.

    A row that has its doc_id alone lies where its doc_id says. Rows that share one, or have none, lie where
    their content and the piece say, so that no doc_id and no repeated row fills a shard.
    """
    equal = sized.groupBy("doc_id", "source", "row_hash", "size").agg(F.count("*").alias("rows"))
    equal = work.store(equal, "equal-rows")
    shared = work.store(equal.groupBy("doc_id").agg(F.count("*").alias("texts"), F.sum("rows").alias("all"))
                        .where("all > 1").select("doc_id", "texts"), "shared-ids")
    most = F.greatest(F.lit(1), F.least(F.lit(piece_rows), F.expr(f"{piece_words:d} div greatest(size, 1)")))
    pieces = (equal.withColumn("most", most.cast("long"))
              .withColumn("piece", F.explode(F.expr("sequence(0, (rows - 1) div most)")))
              .withColumn("n", F.least("most", F.col("rows") - F.col("piece") * F.col("most"))))
    name = F.coalesce(F.col("p.doc_id").cast("string"), F.lit("null"))
    alone = F.col("i.texts").isNull()
    place = F.md5(F.when(alone, F.concat_ws(":", F.lit(seed), name)).otherwise(
        F.concat_ws(":", F.lit(seed), name, "p.row_hash", "p.piece")))
    return pieces.alias("p").join(shared.alias("i"), same("p", "i", "doc_id"), "left").select(
        "p.doc_id", "p.source", "p.row_hash", "p.size", "p.piece", "p.n", place.alias("place"))


def mix_sources(docs: DataFrame, weights=WEIGHTS, share: float = 1.0, most: int = MOST_REPEATS,
                block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, shard_rows: int = SHARD_ROWS,
                piece_words: int = PIECE_WORDS, piece_rows: int = PIECE_ROWS,
                seed: str = "mix", work: Work | None = None) -> DataFrame:
    """Per document (doc_id, text, source) its words, its source's, the target, and the words taken.

    Sources in code point order, null last, take the weights in turn and share that part of all
    words. Blocks of equal size go to the sources by highest quotients, and those of a source to
    its shards. In a shard the documents lie in seeded order around a circle of words; its quota
    runs around the circle from a seeded block, so that a document is taken some whole number of
    times, and the ones at the ends in part.

    No word is taken more than ``most`` times. Null texts have no words; documents without words
    are returned with nothing taken; many of them make shards too. Repeated rows are laid out one
    after the other, in pieces that are dealt to the shards, as are rows that share a doc_id or have
    none. Ties in the seeded order go by doc_id, size, content and piece. Texts of any length
    count whole; one text is never split over shards. An empty table gives an empty one; other
    columns are not read.
    """
    work = work or Work(docs.sparkSession, "mix")
    text = F.coalesce(docs["text"], F.lit(""))
    sized = work.store(docs.select(
        "doc_id", "source", F.xxhash64("text", "source").alias("row_hash"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("size")), "sized")
    per_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    sources = work.store(with_targets(work, per_source, weights, share, most), "targets")
    blocks = sources.agg(F.floor(F.sum("target") / block_words + 0.5)).first()[0]
    sources = apportioned(
        work, sources.withColumn("ideal", F.col("target") / block_words)
        .withColumn("total", F.lit(int(blocks or 0))), "sources", [], ["party"], "ideal", "total").select(
        "source", "party", "source_size", "target", F.col("seats").alias("quota"),
        F.greatest(F.ceil(F.col("source_size") / shard_words), F.ceil(F.col("rows") / shard_rows), F.lit(1)).alias("shards"))
    sources = work.store(sources, "quotas")
    pieces = placed_pieces(work, sized, seed, piece_words, piece_rows)
    dealt = (pieces.alias("d").join(sources.alias("s"), same("d", "s", "source"))
             .select("d.*", "s.party", "s.source_size", "s.target", "s.quota", "shards")
             .withColumn("shard", F.conv(F.substring("place", 9, 8), 16, 10).cast("long") % F.col("shards")))
    shards = dealt.groupBy("party", "shard").agg(
        F.sum(F.col("size") * F.col("n")).alias("shard_size"), F.max("quota").alias("quota"),
        F.max("source_size").alias("all"))
    shards = apportioned(
        work, shards.withColumn("ideal", F.coalesce(
            F.col("quota") * F.col("shard_size") / F.nullif("all", F.lit(0)), F.lit(0.0))),
        "shards", ["party"], ["shard"], "ideal", "quota")
    size, block = F.col("shard_size"), F.lit(block_words)
    begin = seeded(F.lit(seed), "party", "shard") % F.greatest(F.ceil(size / block), F.lit(1)) * block
    shards = work.store(shards.select(
        "party", "shard", "shard_size", begin.alias("begin"),
        F.least(F.col("seats") * block, most * size).alias("words")), "shards")
    around = Window.partitionBy("party", "shard").orderBy("place", "doc_id", "size", "row_hash", "piece")
    filled = F.sum(F.col("size") * F.col("n")).over(around.rowsBetween(Window.unboundedPreceding, 0))
    laid = (dealt.withColumn("filled", filled)
            .withColumn("left", F.explode(F.sequence(F.col("n") - 1, F.lit(0).cast("long"), F.lit(-1).cast("long"))))
            .withColumn("stop", F.col("filled") - F.col("left") * F.col("size"))
            .withColumn("start", F.col("stop") - F.col("size")))
    both = laid.join(shards, ["party", "shard"], "left")
    rest = F.col("words") % F.nullif("shard_size", F.lit(0))
    shared = lambda a, b: F.greatest(F.lit(0), F.least(F.col("stop"), b) - F.greatest(F.col("start"), a))
    begin = F.col("begin")
    taken = (F.expr("words div nullif(shard_size, 0)") * F.col("size") + shared(begin, begin + rest)
             + shared(begin - F.col("shard_size"), begin + rest - F.col("shard_size")))
    return both.select("doc_id", "row_hash", "size", "source_size", "target",
                       F.coalesce(taken, F.lit(0)).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every document as often as its taken words say, rounded to whole copies.

    Rows equal in doc_id, text and source share their copies evenly. Documents without words, so also
    null and empty texts, bring no words to the mix and are not in it; an empty table gives an
    empty one. A null doc_id or source is a value like any other. All columns are returned,
    whatever their names.
    """
    work = Work(docs.sparkSession, "mix")
    copies = (mix_sources(docs, work=work, **options).groupBy("doc_id", "row_hash")
              .agg(F.sum("taken").alias("t"), F.sum("size").alias("s"))
              .select("doc_id", "row_hash", F.floor(F.col("t") / F.nullif("s", F.lit(0)) + 0.5)
                      .cast("int").alias("copies")).where("copies > 0"))
    copies = work.store(copies, "copies")
    on = (F.col("d.doc_id").eqNullSafe(F.col("c.doc_id"))
          & (F.xxhash64("d.text", "d.source") == F.col("c.row_hash")))
    return (docs.alias("d").join(copies.alias("c").hint("merge"), on)
            .select("d.*", F.explode(F.sequence(F.lit(1), F.col("c.copies"))).alias(free_name(docs, "copy_number")))
            .select(*[F.col(f"`{c}`") for c in docs.columns]))
