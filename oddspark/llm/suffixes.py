"""Removal of byte strings that occur twice, by names of sampled suffixes."""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddspark.llm.minhash import mixed, whole_groups
from oddspark.llm.shared import Work

#: A perfect difference cover: for any two positions some shift below PERIOD takes both to places of
#: the cover (fixed values).
PERIOD, COVER = 57, (1, 6, 7, 9, 19, 38, 42, 49)
#: Names of a bucket that one task compares, about.
BUCKET = 1_000_000
#: Bytes of a name that travel. Names of samples only say what is worth comparing, so their low bytes do;
#: names of strings decide and travel whole.
SENT = {"names": 6, "strings": 8}

LETTERS = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
BASE = 0xD1342543DE82EF95


class Powers:
    """Powers of the base and of its inverse modulo 2 ** 64, as far as needed so far."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> None:
        if n > len(self.up):
            n = max(n, 2 * len(self.up))
            for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
                powers = np.full(n, base, np.uint64)
                powers[0] = 1
                setattr(self, name, np.cumprod(powers))


def prefix_sums(data: np.ndarray, powers: Powers) -> np.ndarray:
    powers.to(len(data) + 1)
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(LETTERS[data] * powers.up[:len(data)])])


def names(sums: np.ndarray, at: np.ndarray, length: int, powers: Powers) -> np.ndarray:
    """The 64-bit hash of the ``length`` bytes at each place, from sums over the text before."""
    return mixed((sums[at + length] - sums[at]) * powers.down[at])


def sampled(n: int, length: int) -> np.ndarray:
    """The places of the cover in a text of ``n`` bytes from which ``length`` bytes follow."""
    place = np.arange(max(n - length + 1, 0))
    return place[np.isin(place % PERIOD, COVER)] if n < 4 * PERIOD else place[_COVERED[place % PERIOD]]


_COVERED = np.isin(np.arange(PERIOD), COVER)


def planes(values: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of whole numbers, all first bytes, then all second ones, and so on.

    Places grow slowly, so most planes are runs, which the shuffle's compression takes away.
    """
    raw = values.astype("<u8").view(np.uint8).reshape(-1, 8)
    return raw[:, :width].T.tobytes()


def unplaned(data: bytes, width: int) -> np.ndarray:
    raw = np.zeros((len(data) // width, 8), np.uint8)
    raw[:, :width] = np.frombuffer(data, np.uint8).reshape(width, -1).T
    return raw.view("<u8").ravel()


SENT_ROWS = "bucket int, known boolean, keys binary, owner binary, place binary, name binary"
FOUND = "key long, places binary"
PACKED = "slot int, keys binary, sizes binary, places binary"


def dealt(name, owner, place, keys, buckets: int, width: int):
    """Rows for the buckets: of names met twice in this batch only one goes, marked as known.

    So a string that a third of all texts hold reaches its bucket as one name per batch. Yields
    the batch, and after it the places that are already known to repeat (owner, place).
    """
    order = np.argsort(name, kind="stable")
    name, owner, place = name[order], owner[order], place[order]
    new = np.ones(len(name), bool)
    new[1:] = name[1:] != name[:-1]
    group = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    other = (keys[owner] != keys[owner[first]][group]) | (place != place[first][group])
    known = np.bincount(group, other, len(first)) > 0
    twice = known[group]
    bucket = (((name[first] >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)
    rows = {c: [] for c in ("bucket", "known", "keys", "owner", "place", "name")}
    tag = 2 * bucket + known
    by = np.lexsort((place[first], owner[first], tag))
    for part in np.split(by, np.flatnonzero(np.diff(tag[by])) + 1):
        if len(part):
            at = first[part]
            used, local = np.unique(owner[at], return_inverse=True)
            for c, v in (("bucket", int(bucket[part[0]])), ("known", bool(known[part[0]])), ("keys", keys[used].tobytes()),
                         ("owner", planes(local, 4)), ("place", planes(place[at], 4)), ("name", planes(name[at], width))):
                rows[c].append(v)
    kinds = [pa.int32(), pa.bool_(), *[pa.binary()] * 4]
    sent = pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(rows.values(), kinds, strict=True)], list(rows))
    return sent, owner[twice], place[twice]


def per_key(keys: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, how many places each has, and all places in that order, ascending per key."""
    order = np.lexsort((places, keys))
    keys, places = keys[order], places[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, int)
    return keys[starts], np.diff(np.append(starts, len(keys))), places


def packed(keys: np.ndarray, places: np.ndarray, slots: int) -> pa.RecordBatch:
    """Places of many texts as a row per slot; a text always falls into the same one."""
    slot = (keys.view(np.uint64) % np.uint64(slots)).astype(np.int32)
    order = np.argsort(slot, kind="stable")
    rows = []
    for part in np.split(order, np.flatnonzero(np.diff(slot[order])) + 1):
        if len(part):
            own, sizes, found = per_key(keys[part], places[part])
            rows.append((int(slot[part[0]]), own.tobytes(), planes(sizes, 4), planes(found, 4)))
    columns = [list(c) for c in zip(*rows, strict=True)] if rows else [[]] * 4
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[0], pa.int32()), *[pa.array(c, pa.binary()) for c in columns[1:]]],
        ["slot", "keys", "sizes", "places"])


def unpacked(batches):
    """Rows sorted by slot -> one row per text, with all of its places."""
    for table, starts in whole_groups(batches, ["slot"]):
        columns = [table.column(c).to_pylist() for c in ("keys", "sizes", "places")]
        for s, e in zip(starts, np.append(starts[1:], table.num_rows), strict=True):
            keys = np.concatenate([np.repeat(np.frombuffer(k, np.int64), unplaned(n, 4).astype(np.int64))
                                   for k, n in zip(columns[0][s:e], columns[1][s:e], strict=True)])
            own, sizes, places = per_key(keys, np.concatenate([unplaned(p, 4) for p in columns[2][s:e]]))
            data = [planes(p, 4) for p in np.split(places, np.cumsum(sizes)[:-1])] if len(own) else []
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(data, pa.binary())], ["key", "places"])


def compared(width: int, repeated: bool, slots: int):
    """Buckets -> the places whose name another place has, or with ``repeated`` off, those without."""
    def run(batches):
        for table, starts in whole_groups(batches, ["bucket"]):
            columns = [table.column(c).to_pylist() for c in ("known", "keys", "owner", "place", "name")]
            for s, e in zip(starts, np.append(starts[1:], table.num_rows), strict=True):
                known, key, place, name = [], [], [], []
                for row in zip(*[c[s:e] for c in columns], strict=True):
                    place.append(unplaned(row[3], 4))
                    name.append(unplaned(row[4], width))
                    key.append(np.frombuffer(row[1], np.int64)[unplaned(row[2], 4).astype(np.int64)])
                    known.append(np.full(len(place[-1]), row[0]))
                known, key, place, name = map(np.concatenate, (known, key, place, name))
                order = np.argsort(name, kind="stable")
                known, key, place, name = known[order], key[order], place[order], name[order]
                equal = name[1:] == name[:-1]
                differ = equal & ((key[1:] != key[:-1]) | (place[1:] != place[:-1]))
                group = np.concatenate([[0], np.cumsum(~equal)])
                hit = (np.bincount(group[1:], differ, group[-1] + 1) + np.bincount(group, known, group[-1] + 1)) > 0
                chosen = hit[group] == repeated
                yield packed(key[chosen], place[chosen].astype(np.int64), slots)

    return run


def by_bucket(df: DataFrame, column: str, run, schema: str) -> DataFrame:
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(parts, column).sortWithinPartitions(column).mapInArrow(run, schema)


def bucketed(sent: DataFrame, width: int, repeated: bool, slots: int) -> DataFrame:
    """(key, places) of the names that repeat, or of those that don't."""
    return by_bucket(by_bucket(sent, "bucket", compared(width, repeated, slots), PACKED), "slot", unpacked, FOUND)


def joined_text(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts of a batch, and where each begins."""
    raw = [t.encode("utf-8", "surrogatepass") for t in batch.column("text").to_pylist()]
    sizes = np.array([len(r) for r in raw], np.int64)
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum(sizes)])


def slices(batches, rows: int = 300):
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)


def candidates(n: int, hits: np.ndarray, length: int) -> np.ndarray:
    """Whether a string that starts at each place may repeat: a sampled place of it within PERIOD does."""
    near = np.zeros(n + 2, np.int32)
    np.add.at(near, np.maximum(hits - PERIOD + 1, 0), 1)
    np.add.at(near, hits + 1, -1)
    may = np.cumsum(near)[:max(n - length + 1, 0)] > 0
    return np.flatnonzero(may)


def removed_spans(n: int, starts: np.ndarray, length: int) -> list[tuple[int, int]]:
    """The maximal runs of bytes under strings of ``length`` from the given starts, ascending."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > length) + 1
    return [(int(p[0]), int(p[-1]) + length) for p in np.split(starts, cut)]


def dedup_strings(docs: DataFrame, length: int = 200) -> DataFrame:
    """Per document (doc_id, text): n_bytes, n_removed, n_spans, kept_sha256, and the kept bytes.

    Each UTF-8 byte goes that is covered by a ``length``-byte string which starts anywhere else
    too. Suffixes are sampled at the places of a difference cover, so any two equal strings hold a pair of
    samples at the same distance from their starts. Samples are named by the bytes that such a
    pair must share, and names sorted in buckets. Only strings around a repeated name can repeat; the
    merge compares those with each other the same way, at every place.

    Names are 64-bit hashes computed from the text, not ranks got by recursion, as nothing is
    compared beyond ``length`` bytes. Two different strings with one hash would count as equal.

    Equal texts are handled once; if they reach ``length``, all of their bytes go. Texts move once,
    one of each per task, to meet the places found; those with such places are stored, and only
    their lengths and digests meet the documents again. Null and empty texts have no bytes. A
    text's own repeats count. Repeated rows are copies of each other. Texts of any length are read
    whole; matches never cross documents. An empty table gives an empty one; other columns are not read.
    """
    spark, work, reach = docs.sparkSession, Work(docs.sparkSession, "strings"), length - PERIOD + 1
    text = F.coalesce("text", F.lit(""))
    ready = docs.select("doc_id", text.alias("text")).withColumns({
        "key": F.xxhash64("text"), "n": F.octet_length("text").cast("long"), "whole_sha256": F.sha2("text", 256)})
    classes = work.store(ready.groupBy("key").agg(
        F.count("*").alias("copies"), F.max("n").alias("n")), "classes")
    total = classes.agg(F.sum("n")).first()[0] or 0
    buckets = max(1, -(-total * len(COVER) // (PERIOD * BUCKET)))

    def named(batches):
        powers = Powers()
        for batch in slices(batches):
            data, bounds = joined_text(batch)
            sums, keys = prefix_sums(data, powers), np.array(batch.column("key"))
            at = [sampled(int(n), reach) for n in np.diff(bounds)]
            owner = np.repeat(np.arange(len(at)), [len(a) for a in at])
            place = np.concatenate(at)
            sent, own, twice = dealt(names(sums, bounds[owner] + place, reach, powers), owner, place, keys, buckets, SENT["names"])
            yield sent
            if len(own):
                yield local(keys[own], twice)

    # Places found within a batch travel beside the names, in buckets of their own.
    def local(keys, places):
        rows = packed(keys, places, buckets)
        n = rows.num_rows
        return pa.RecordBatch.from_arrays(
            [pa.array(-1 - np.array(rows.column("slot")), pa.int32()), pa.array([True] * n, pa.bool_()), rows.column("keys"),
             rows.column("sizes"), rows.column("places"), pa.array([b""] * n, pa.binary())], SENT_NAMES)

    sent = ready.select("key", "text").mapInArrow(named, SENT_ROWS)
    hits = by_bucket(sent, "bucket", passed_on(compared(SENT["names"], True, buckets)), PACKED)
    hits = work.store(by_bucket(hits, "slot", unpacked, FOUND), "hits")

    def stringed(batches):
        powers = Powers()
        for batch in slices(batches):
            keys, (data, bounds) = np.array(batch.column("key")), joined_text(batch)
            sums = prefix_sums(data, powers)
            at = [candidates(int(n), unplaned(p, 4).astype(np.int64), length)
                  for n, p in zip(np.diff(bounds), batch.column("places").to_pylist(), strict=True)]
            owner = np.repeat(np.arange(len(at)), [len(a) for a in at])
            place = np.concatenate(at)
            if len(place):
                yield dealt(names(sums, bounds[owner] + place, length, powers), owner, place, keys, buckets, SENT["strings"])[0]

    # One text of each key leaves a task; the join finds them dealt by key already.
    texts = ready.groupBy("key").agg(F.max("text").alias("text")).join(hits.hint("merge"), "key")
    texts = work.store(texts, "texts")
    work.drop("hits")
    # What returns are the candidates that do not repeat, the fewer ones.
    sent = texts.select("key", "text", "places").mapInArrow(stringed, SENT_ROWS)
    single = work.store(bucketed(sent, SENT["strings"], False, buckets), "single").withColumnRenamed("places", "single")

    def finished(batches):
        for batch in slices(batches):
            out = []
            for text, places, alone in zip(*[batch.column(c).to_pylist() for c in ("text", "places", "single")], strict=True):
                raw, kept, at = text.encode("utf-8", "surrogatepass"), [], 0
                starts = candidates(len(raw), unplaned(places, 4).astype(np.int64), length)
                starts = np.setdiff1d(starts, unplaned(alone or b"", 4).astype(np.int64), assume_unique=True)
                spans = removed_spans(len(raw), starts, length)
                for a, b in spans:
                    kept.append(raw[at:a])
                    at = b
                kept = b"".join([*kept, raw[at:]])
                out.append((len(raw) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), kept))
            columns = [list(c) for c in zip(*out, strict=True)] if out else [[]] * 4
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]],
                ["key", "removed", "spans", "rest_sha256", "rest"])

    cut = texts.join(single.hint("merge"), "key", "left").select("key", "text", "places", "single").mapInArrow(
        finished, "key long, removed long, spans long, rest_sha256 string, rest binary")
    cut = work.store(cut, "cut")
    work.drop("texts", "single")
    # Copies go whole if they are long enough; shorter ones can't hold a string of that length.
    marks = classes.select("key", ((F.col("copies") > 1) & (F.col("n") >= length)).alias("copied")).join(
        cut, "key", "left").where("copied or removed is not null")
    joined = ready.join(marks.hint("merge"), "key", "left")
    case = lambda copied, found, none: F.when(F.col("copied"), copied).otherwise(F.coalesce(found, none))
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    return joined.select(
        "doc_id", F.col("n").alias("n_bytes"), case(F.col("n"), F.col("removed"), F.lit(0)).cast("long").alias("n_removed"),
        case(F.lit(1), F.col("spans"), F.lit(0)).cast("long").alias("n_spans"),
        case(empty, F.col("rest_sha256"), F.col("whole_sha256")).alias("kept_sha256"),
        case(F.lit(b""), F.col("rest"), F.col("text").cast("binary")).alias("kept"))


SENT_NAMES = [x.split()[0] for x in SENT_ROWS.split(", ")]


def passed_on(run):
    """Compared buckets, and the places that were known before as they are."""
    def both(batches):
        def names_only():
            for batch in batches:
                before = np.array(batch.column("bucket")) < 0
                rows = batch.filter(pa.array(before))
                if rows.num_rows:
                    slot = pa.array(-1 - np.array(rows.column("bucket")), pa.int32())
                    ready.append(pa.RecordBatch.from_arrays(
                        [slot, rows.column("keys"), rows.column("owner"), rows.column("place")],
                        ["slot", "keys", "sizes", "places"]))
                rest = batch.filter(pa.array(~before))
                if rest.num_rows:
                    yield rest

        ready = []
        for found in run(names_only()):
            yield from ready
            ready.clear()
            yield found
        yield from ready

    return both
