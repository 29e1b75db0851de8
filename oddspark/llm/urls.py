"""Url verdicts: rules first, then the ratio of two character language models."""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oddspark.llm.shared import Work

#: (host, path, verdict)
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"),
         ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: The longest context, and how many symbols there are, of so many bits each.
ORDER, SYMBOLS, BITS = 5, 64, 6
#: Bits of a symbol with its longest context.
WHOLE = BITS * (ORDER + 1)
#: Log-likelihoods are summed as whole numbers of 1 / UNIT.
UNIT = 1_000_000_000
#: Rows of a bucket in which counts meet grams; the least number of buckets; grams that are broadcast.
BUCKET_ROWS, LEAST_BUCKETS, HOT = 100_000, 256, 1000
#: Scores are calibrated in steps of STEP between -EDGE and EDGE.
STEP, EDGE = 0.01, 8.0

ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789-._~:/?#[]@!$&'()*+,;=%"
CODE = np.full(256, SYMBOLS - 1, np.int64)
CODE[[ord(c) for c in ALPHABET]] = np.arange(1, len(ALPHABET) + 1)
CODE[[ord(c) for c in ALPHABET[:26].upper()]] = np.arange(1, 27)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Both empty for a null or a url without ``://``."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    upper = ALPHABET[:26].upper()
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), upper, upper.lower())
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def ruled(urls: DataFrame, rules=RULES) -> DataFrame:
    """Adds host, path, rule and the rule's verdict, null where none fits; the longest rule wins."""
    host, path = host_and_path(F.col("url"))
    found = urls.withColumn("host", host).withColumn("path", path)
    rule = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return found.withColumn("rule", rule).withColumn("ruled", verdict)


def grams_in(urls: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Per byte of all urls: the ORDER symbols before it and itself, as one number, and its url.

    The last symbol has the lowest bits; places before a url's beginning hold 0, which is no symbol.
    """
    raw = [(u or "").encode("utf-8", "surrogatepass") for u in urls.to_pylist()]
    lengths = np.array([len(r) for r in raw], np.int64)
    symbols = CODE[np.frombuffer(b"".join(raw), np.uint8)]
    owner = np.repeat(np.arange(len(raw)), lengths)
    place = np.arange(len(symbols)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    grams = symbols.copy()
    for back in range(1, ORDER + 1):
        before = np.zeros(len(symbols), np.int64)
        before[back:] = symbols[:-back]
        grams += np.where(place >= back, before, 0) << (BITS * back)
    return grams, owner


def cells_of(accepted: int, order: int, grams: np.ndarray) -> np.ndarray:
    """The number of each gram's cell: class, order, and the gram cut to that order."""
    return ((accepted * (ORDER + 1) + order) << WHOLE) | (grams & ((1 << BITS * (order + 1)) - 1))


def counted(batches):
    """(cell, n): how often each symbol follows each context of every order, per class."""
    for batch in batches:
        cells = [np.zeros(0, np.int64)]
        for accepted in (0, 1):
            part = batch.filter(pa.array(np.array(batch.column("accepted")) == accepted))
            grams, _ = grams_in(part.column("url"))
            cells += [cells_of(accepted, k, grams) for k in range(ORDER + 1)]
        cell, n = np.unique(np.concatenate(cells), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(n.astype(np.int64))], ["cell", "n"])


def found(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The values at ``wanted`` of sorted ``keys``, 0 where there is none."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], 0)


class Ratio:
    """Two variable-order models with interpolated (Witten-Bell) smoothing, over exact counts."""

    def __init__(self, cell: np.ndarray, n: np.ndarray):
        order = np.argsort(cell)
        self.cell, self.n = cell[order], n[order]
        self.context, first, self.kinds = np.unique(self.cell >> BITS, return_index=True, return_counts=True)
        self.seen = np.add.reduceat(self.n, first) if len(first) else self.n

    def logs(self, accepted: int, grams: np.ndarray) -> np.ndarray:
        chance = np.full(len(grams), 1 / SYMBOLS)
        for k in range(ORDER + 1):
            cells = cells_of(accepted, k, grams)
            seen, kinds = (found(self.context, v, cells >> BITS) for v in (self.seen, self.kinds))
            met = found(self.cell, self.n, cells)
            chance = np.where(seen > 0, (met + kinds * chance) / np.maximum(seen + kinds, 1), chance)
        return np.log(chance)

    def apart(self, grams: np.ndarray) -> np.ndarray:
        """Difference of the log-likelihoods, accepted less rejected, in whole units of 1 / UNIT.

        Sums of whole numbers don't depend on the order of rows.
        """
        return np.rint((self.logs(1, grams) - self.logs(0, grams)) * UNIT).astype(np.int64)

    def scores(self, urls: pa.Array) -> np.ndarray:
        """Mean difference per byte."""
        grams, owner = grams_in(urls)
        sums, n = np.zeros(len(urls), np.int64), np.bincount(owner, minlength=len(urls))
        np.add.at(sums, owner, self.apart(grams))
        return sums / UNIT / np.maximum(n, 1)


def postings(batches):
    """(id, gram, n): the distinct grams of each url."""
    for batch in batches:
        grams, owner = grams_in(batch.column("url"))
        order = np.lexsort((grams, owner))
        grams, owner = grams[order], owner[order]
        first = np.flatnonzero(np.diff(grams, prepend=-1).astype(bool) | np.diff(owner, prepend=-1).astype(bool))
        n = np.diff(first, append=len(grams))
        yield pa.RecordBatch.from_arrays([
            batch.column("id").take(pa.array(owner[first])), pa.array(grams[first]), pa.array(n.astype(np.int64))],
            ["id", "gram", "n"])


def gram_ratios(cells: DataFrame, grams: DataFrame, work: Work) -> DataFrame:
    """(gram, apart) for all of ``grams`` (gram), under the counts in ``cells`` (cell, n).

    Counts and grams meet by the three symbols before the last one, in buckets whose number grows
    with both. No bucket gets large by a common url, as both are distinct there. The counts of
    contexts of up to two symbols are bounded (64^3 of a class and order) and go to all buckets.
    """
    order = F.shiftright("cell", WHOLE) % (ORDER + 1)
    low = cells.where(order < 3).toArrow()
    low = work.spark.sparkContext.broadcast([low.column(c).to_numpy() for c in ("cell", "n")])
    buckets = max(LEAST_BUCKETS, -(-(cells.count() + grams.count()) // BUCKET_ROWS))

    def dealt(c):
        return F.pmod(F.xxhash64(F.shiftright(c, BITS).bitwiseAND((1 << 3 * BITS) - 1)), F.lit(buckets))

    def run(counts: pa.Table, wanted: pa.Table) -> pa.Table:
        own = [counts.column(c).to_numpy() for c in ("cell", "n")]
        model = Ratio(*(np.concatenate([a, b]) for a, b in zip(low.value, own, strict=True)))
        gram = wanted.column("gram").to_numpy()
        return pa.table({"gram": gram, "apart": model.apart(gram)})

    high = cells.where(order >= 3).withColumn("bucket", dealt("cell"))
    return (high.groupBy("bucket").cogroup(grams.withColumn("bucket", dealt("gram")).groupBy("bucket"))
            .applyInArrow(run, "gram long, apart long"))


def scored(df: DataFrame, cells: DataFrame, work: Work) -> DataFrame:
    """``df`` with the score of ``url``, under the counts in ``cells``.

    Distinct urls are scored, by joins of their distinct grams with those of the model.
    """
    names = work.store(df.where("url <> ''").select("url").distinct()
                       .withColumn("id", F.monotonically_increasing_id()), "urls")
    posted = work.store(names.mapInArrow(postings, "id long, gram long, n long"), "postings")
    grams = work.store(posted.groupBy("gram").agg(F.count("*").alias("urls")), "grams")
    ratios = work.store(gram_ratios(cells, grams.select("gram"), work), "ratios")
    # The most common grams, a fixed number, are broadcast, so that no other one has more than a
    # HOT-th of all postings.
    hot = work.store(grams.orderBy(F.desc("urls"), "gram").limit(HOT).select("gram")
                     .join(ratios.hint("merge"), "gram"), "hot")
    rest = posted.join(F.broadcast(hot.select("gram")), "gram", "left_anti").join(ratios.hint("merge"), "gram")
    parts = posted.join(F.broadcast(hot), "gram").select("id", "n", "apart").union(rest.select("id", "n", "apart"))
    sums = parts.groupBy("id").agg(F.sum(F.col("n") * F.col("apart")).alias("apart"), F.sum("n").alias("n"))
    scores = names.join(sums.hint("merge"), "id").select("url", (F.col("apart") / UNIT / F.col("n")).alias("s"))
    done = df.join(scores.hint("merge"), "url", "left").withColumn("score", F.coalesce("s", F.lit(0.0))).drop("s")
    done = work.store(done.select(*df.columns, "score").drop("url"), "scored")
    work.drop("urls", "postings", "grams", "ratios", "hot")
    return done


def calibrated(bins: DataFrame) -> float:
    """The score that parts held-out accepted and rejected urls best; 0 where a class is missing.

    ``bins`` has a row per class and step of the score, a bounded number.
    """
    held = np.zeros((2, int(2 * EDGE / STEP) + 1))
    for accepted, step, n in bins.collect():
        held[accepted, step] = n
    if not held.sum(1).all():
        return 0.0
    share = held / held.sum(1, keepdims=True)
    below = np.concatenate([[[0], [0]], np.cumsum(share, 1)], 1)
    best = below[0] - below[1]
    top = np.flatnonzero(best >= best.max() - 1e-12)
    return float(top[len(top) // 2] * STEP - EDGE)


def judge_urls(pages: DataFrame, rules=RULES) -> DataFrame:
    """Verdict per row (page_id, url): the longest rule that fits, else the language models'.

    The rules label the urls that they fit. Three quarters of them, by a checksum of the url, count
    into a model of accepted and one of rejected urls; the rest calibrate the threshold of the
    score. All rows are counted, none sampled, every context exactly, in a table that grows with
    the urls; the counts that calibrate the threshold have a fixed size and go through the driver.

    A null or empty url scores 0 and is judged by that. Scores at the threshold are allowed. Long
    urls count in full, repeated rows as often as they occur. Without labelled urls all scores are 0
    and are allowed. An empty table gives an empty one. Other columns are not read.
    """
    work = Work(pages.sparkSession, "urls")
    rows = ruled(pages.select("page_id", "url"), rules).withColumn("fold", F.crc32(F.col("url").cast("binary")) % 4)
    accepted = (F.col("ruled") == "allow").cast("int")
    cells = (rows.where("ruled is not null and fold <> 0").select("url", accepted.alias("accepted"))
             .mapInArrow(counted, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")))
    done = scored(rows, work.store(cells, "cells"), work)
    step = F.floor((F.greatest(F.least(F.col("score"), F.lit(EDGE)), F.lit(-EDGE)) + EDGE) / STEP)
    bins = (done.where("ruled is not null and fold = 0")
            .groupBy(accepted.alias("accepted"), step.cast("int").alias("step")).agg(F.count("*").alias("n")))
    threshold = calibrated(bins)
    by_model = F.when(F.col("score") >= threshold, "allow").otherwise("block")
    return done.select("page_id", "host", "path", "rule", F.coalesce("ruled", by_model).alias("verdict"), "score")
