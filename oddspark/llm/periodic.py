"""Stretches of words that repeat with a period: seeds from minimizers of several scales, extended exactly."""

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oddspark.llm.shared import words

#: A run has at least this many words, and this many periods.
LEAST, PERIODS = 24, 3
#: Periods up to this many words are found by comparing words that far apart.
DIRECT = 8
#: Words that are looked at in one go; a longer text is a block of its own.
BLOCK = 1 << 18

_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mixed(x: np.ndarray) -> np.ndarray:
    """Well spread 64-bit values, different for different inputs."""
    x = x.astype(np.uint64) * _MIX[0]
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


def coded(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One number per word, equal for equal words, the texts one after another, each closed by a
    number of its own; where each text starts; and its number of words."""
    sizes = np.array([len(t) for t in texts], np.int64)
    starts = np.cumsum(sizes + 1) - (sizes + 1)
    known = pa.array(chain.from_iterable(texts), pa.binary()).dictionary_encode()
    ids = np.empty(int(sizes.sum()) + len(texts), np.int64)
    ends = starts + sizes
    ids[ends] = len(known.dictionary) + np.arange(len(texts))
    inside = np.ones(len(ids), bool)
    inside[ends] = False
    ids[inside] = known.indices.to_numpy()
    return ids, starts, sizes


def slid(x: np.ndarray, width: int, best) -> np.ndarray:
    """``best`` (np.minimum or np.maximum) of every window of ``width`` values."""
    reach = 1
    while 2 * reach <= width:
        x, reach = best(x[:-reach], x[reach:]), 2 * reach
    return best(x[:len(x) - (width - reach)], x[width - reach:])


def minimizers(h: np.ndarray, window: int) -> np.ndarray:
    """Places that hold the least value of some window; all of them if several do."""
    if len(h) < window:
        return np.zeros(0, np.int64)
    least = np.pad(slid(h, window, np.minimum), window - 1)
    return np.flatnonzero(slid(least, window, np.maximum) == h)


def repeats_inside(ids: np.ndarray, owner: np.ndarray, width: int) -> np.ndarray:
    """The texts that hold some ``width`` words (a power of two) twice, perhaps a few more."""
    h, reach = mixed(ids), 1
    while reach < width:
        h = mixed(h[:-reach] * np.uint64(3) + h[reach:])
        reach *= 2
    own = owner[:len(h)]
    h = h ^ mixed(own)
    order = np.argsort(h)
    again = np.flatnonzero(h[order[1:]] == h[order[:-1]])
    return np.unique(own[order[again]])


def scaled_seeds(ids: np.ndarray, room: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, periods): pairs of equal word groups a possible period apart, for periods above ``DIRECT``.

    A scale covers the periods from ``low + 1`` to ``wide`` and looks at groups of ``wide`` words. As a
    group is no shorter than the period, two groups of a run are equal only if whole periods lie
    between them. The window is as long as a run of three periods has room for twice, so the
    least group of a window is again the least of the window one period on: both are minimizers,
    and next to each other among those that are equal. Groups have exact names: equal names
    mean equal words. ``room`` is the length of the text that a place lies in.
    """
    place = np.arange(len(ids))
    name, reach, low = ids, 1, DIRECT
    while len(name):
        wide = low + max(1, low // 4)
        while 2 * reach <= wide and len(name) > reach:
            code = name[:-reach] * (int(name.max()) + 1) + name[reach:]
            name, place, room = np.unique(code, return_inverse=True)[1], place[:-reach], room[:-reach]
            reach *= 2
            fits = room >= PERIODS * (low + 1)
            name, place, room = name[fits], place[fits], room[fits]
        rest = wide - reach
        if len(name) <= max(rest, reach) or room.max() < PERIODS * (low + 1):
            return
        h = mixed(name[:len(name) - rest] * (int(name.max()) + 1) + name[rest:])
        at = minimizers(h, 2 * (low + 1) - wide + 1)
        at = at[np.argsort(h[at], kind="stable")]
        here, there = place[at[:-1]], place[at[1:]]
        apart = there - here
        seed = (h[at[:-1]] == h[at[1:]]) & (apart > low) & (apart <= wide)
        yield here[seed], apart[seed]
        low = wide


def extended(ids: np.ndarray, at: np.ndarray, lag: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(start, stop, period) of the stretches around seeds in which words ``lag`` apart are equal."""
    order = np.lexsort((at, lag))
    last = (0, 0)
    for i, q in zip(at[order].tolist(), lag[order].tolist(), strict=True):
        if last[0] == q and i < last[1]:
            continue
        start, step = i, 64
        while start > 0:
            lo = max(0, start - step)
            differ = np.flatnonzero(ids[lo:start] != ids[lo + q:start + q])
            if len(differ):
                start = lo + int(differ[-1]) + 1
                break
            start, step = lo, 2 * step
        stop, step = i, 64
        while stop + q < len(ids):
            hi = min(len(ids) - q, stop + step)
            differ = np.flatnonzero(ids[stop:hi] != ids[stop + q:hi + q])
            if len(differ):
                stop += int(differ[0])
                break
            stop, step = hi, 2 * step
        last = (q, stop)
        yield start, stop + q, q


def direct(ids: np.ndarray, lag: int) -> Iterator[tuple[int, int, int]]:
    """The same for one short period, by comparing all words that far apart."""
    differ = np.flatnonzero(ids[lag:] != ids[:-lag])
    edges = np.concatenate([[-1], differ, [len(ids) - lag]])
    for k in np.flatnonzero(np.diff(edges) > LEAST - lag).tolist():
        yield int(edges[k]) + 1, int(edges[k + 1]) + lag, lag


def found_runs(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """Per text its runs (start, length, period), by start and period.

    A stretch found with several periods has the smallest one: of at least three periods, all its
    periods are multiples of that.
    """
    runs: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if not texts:
        return runs
    ids, starts, sizes = coded(texts)
    owner = np.repeat(np.arange(len(texts)), sizes + 1)
    found: dict[tuple[int, int], int] = {}

    def keep(stretches, offset=lambda i: i):
        for start, stop, period in stretches:
            if stop - start >= max(LEAST, PERIODS * period):
                key = (offset(start), stop - start)
                found[key] = min(period, found.get(key, period))

    for lag in range(1, DIRECT + 1):
        if lag < len(ids):
            keep(direct(ids, lag))
    # A run of a longer period holds DIRECT words twice; few texts do.
    again = repeats_inside(ids, owner, DIRECT) if len(ids) >= DIRECT else []
    if len(again):
        chosen = np.flatnonzero(np.isin(owner, again))
        some = ids[chosen]
        for at, lag in scaled_seeds(some, sizes[owner[chosen]]):
            keep(extended(some, at, lag), lambda i: int(chosen[i]))
    for (at, length), period in found.items():
        k = int(owner[at])
        runs[k].append((at - int(starts[k]), length, period))
    return [sorted(r, key=lambda x: (x[0], x[2])) for r in runs]


def collapsed(text: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run contains after its first period, joined by one space."""
    if not runs:
        return b" ".join(text)
    kept = np.ones(len(text), bool)
    for start, length, period in runs:
        kept[start + period:start + length] = False
    return b" ".join(text[i] for i in np.flatnonzero(kept).tolist())


def blocks(texts: pa.Array) -> Iterator[tuple[int, list[list[bytes]]]]:
    """(first row, words of the rows) for neighbouring rows of together about ``BLOCK`` words."""
    first, block, size = 0, [], 0
    for row, text in enumerate(texts):
        # Bytes are split at just the six ASCII characters that part words.
        block.append((text.as_py() or "").encode().split())
        size += len(block[-1])
        if size >= BLOCK:
            yield first, block
            first, block, size = row + 1, [], 0
    if block:
        yield first, block


RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def periodic_runs(docs: DataFrame) -> DataFrame:
    """doc_id, runs (start, length, period, counted in words) and the collapsed text, for every whole text.

    A run is a stretch of words with smallest period q and at least ``LEAST`` words and three
    periods, which no neighbouring word extends. Periods up to ``DIRECT`` are scanned directly,
    longer ones come from minimizers; every stretch is measured by comparing words, so nothing
    rests on hash values. One row for every row of ``docs``, repeated rows and null ids included; a null or empty
    text has no run and an empty collapsed text, as has an empty table no rows. Texts of any length are
    taken whole. Only doc_id and text are read, so other columns may have any name.
    """
    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for first, block in blocks(texts):
                runs = found_runs(block)
                rows = [[dict(zip(RUN.names, r, strict=True)) for r in found] for found in runs]
                plain = [collapsed(t, r).decode() for t, r in zip(block, runs, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(first, len(block)), pa.array(rows, pa.list_(RUN)), pa.array(plain, pa.string())],
                    ["doc_id", "runs", "collapsed"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id and text; of every tenth document by the checksum of its id, the words from some place on
    repeat with some period. Null ids and texts without words stay as they are."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g, n = F.expr("h div 10"), F.size("w")
    # Only read where there are words, but defined everywhere.
    n = F.greatest(n, F.lit(1))
    a = F.pmod("g", n)
    p = 1 + F.floor((n - a) / (3 + F.col("g") % 8))
    chosen = docs.select("doc_id", "text", h.alias("h")).withColumn("g", g).withColumn(
        "w", F.when(F.col("h") % 10 == 0, words(F.col("text"))))
    periodic = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(
        "w", F.when(i < a, i).otherwise(a + (i - a) % p).cast("int")))
    return chosen.select("doc_id", F.when(F.size("w") > 0, F.array_join(periodic, " ")).otherwise(F.col("text")).alias("text"))


def strongest(runs: Column) -> Column:
    """The run with the most periods, compared exactly; of equal ones the first, then that of the smallest period."""
    def better(x: Column, y: Column) -> Column:
        more, less = x["length"] * y["period"], y["length"] * x["period"]
        first = F.struct(x["start"], x["period"]) < F.struct(y["start"], y["period"])
        return (more > less) | ((more == less) & first)

    return F.aggregate(F.slice(runs, 2, F.greatest(F.size(runs), F.lit(1))), F.get(runs, 0),
                       lambda best, x: F.when(better(x, best), x).otherwise(best))


def run_report(docs: DataFrame) -> DataFrame:
    """Per document the number of its runs, the strongest one, and digests of all runs and of the collapsed text."""
    listed = F.transform("runs", lambda r: F.concat(
        r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    best = periodic_runs(docs).withColumn("best", strongest(F.col("runs")))
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(listed, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
