"""Near-duplicates: an inverted join on signature coordinates, confirmed on full shingle sets."""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oddspark.llm.shared import Work, components, same

#: Coordinates of a signature, and the equal ones that make a pair a candidate. Texts at a
#: similarity of 0.8 share fewer than 13 of 32 with a chance of about two in ten million.
COORDINATES, MATCHES = 32, 13
#: Rows of a posting list, and shingles of a candidate group, that meet in one task. Longer ones
#: are split into blocks, and every two blocks meet.
LIST_ROWS, GROUP_SHINGLES = 20_000, 4_000_000

ODD = np.random.default_rng(7).integers(1, 1 << 63, (2, COORDINATES), np.uint64) * np.uint64(2) + np.uint64(1)
STEPS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93,
                  0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x94D049BB133111EB], np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    """Per text the sorted distinct 64-bit hashes of its shingles; none without words.

    Words are parted by ASCII white space, A-Z lower-cased. Fewer words than ``width`` make one
    shingle of them all.
    """
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.large_string()), "")))
    owner, flat = np.asarray(pc.list_parent_indices(lists)), pc.list_flatten(lists)
    full = np.asarray(pc.not_equal(flat, ""), bool)
    owner, coded = owner[full], pc.dictionary_encode(flat.filter(pa.array(full)))
    known = np.array([xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) for w in coded.dictionary.to_pylist()], np.uint64)
    hashes = known[coded.indices.to_numpy()] if len(owner) else np.zeros(0, np.uint64)
    bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
    n = len(hashes)
    grams = np.zeros(max(n - width + 1, 0), np.uint64)
    for k in range(width):
        grams += mixed(hashes[k:k + len(grams)] + STEPS[k]) * STEPS[k]
    grams = mixed(grams)
    sets = []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b - a >= width:
            sets.append(np.unique(grams[a:b - width + 1]))
        elif b > a:
            short = np.frombuffer(hashes[a:b].tobytes(), np.uint8).tobytes()
            sets.append(np.array([xxhash.xxh3_64_intdigest(short, seed=int(b - a))], np.uint64))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """The least hash of every set under each coordinate's function; sets must not be empty."""
    flat = np.concatenate(sets)
    begin = np.cumsum([0, *[len(s) for s in sets[:-1]]])
    out = np.empty((len(sets), COORDINATES), np.uint32)
    for k in range(COORDINATES):
        seen = mixed((flat ^ ODD[0, k]) * ODD[1, k]) >> np.uint64(32)
        out[:, k] = np.minimum.reduceat(seen, begin)
    return out


def signed(width: int):
    """Batches of (doc_id, row_hash, text) -> (doc_id, row_hash, n_shingles, print, sig)."""
    def run(batches):
        for batch in batches:
            sets = shingle_sets(batch.column("text"), width)
            full = [k for k, s in enumerate(sets) if len(s)]
            prints, sigs = [None] * len(sets), [None] * len(sets)
            if full:
                for k, row in zip(full, signatures([sets[k] for k in full]).view(np.int32), strict=True):
                    prints[k] = hashlib.blake2b(sets[k].tobytes(), digest_size=16).digest()
                    sigs[k] = row
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("row_hash"), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array(prints, pa.binary()), pa.array(sigs, pa.list_(pa.int32()))],
                ["doc_id", "row_hash", "n_shingles", "print", "sig"])

    return run


def whole_groups(batches, names: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups with their starts, from batches sorted by ``names``."""
    held = []
    for batch in batches:
        table = pa.Table.from_batches([*held, batch]).combine_chunks()
        starts = starts_of(table, names)
        if len(starts) > 1:
            yield table.slice(0, starts[-1]), starts[:-1]
        held = table.slice(starts[-1]).to_batches() if len(starts) else []
    if held:
        table = pa.Table.from_batches(held).combine_chunks()
        yield table, starts_of(table, names)


def starts_of(table: pa.Table, names: list[str]) -> np.ndarray:
    if not table.num_rows:
        return np.zeros(0, int)
    new = np.zeros(table.num_rows, bool)
    new[0] = True
    for name in names:
        column = table.column(name).to_numpy()
        new[1:] |= column[1:] != column[:-1]
    return np.flatnonzero(new)


def roots(n: int, linked_to) -> np.ndarray:
    """Components among n items by breadth-first search, as the place of a first member.

    ``linked_to(one, rest)`` says which of ``rest`` link with ``one``. Every item is held against
    those not yet reached alone, so that one big component costs little more than its size.
    """
    root, rest = np.arange(n), np.arange(1, n)
    start = 0
    while True:
        queue = [start]
        while queue and len(rest):
            hit = linked_to(queue.pop(), rest)
            root[rest[hit]] = start
            queue.extend(rest[hit].tolist())
            rest = rest[~hit]
        if not len(rest):
            return root
        start, rest = int(rest[0]), rest[1:]


def matched(least: int):
    """Sorted posting lists -> links (a, b) that connect members sharing ``least`` coordinates."""
    def run(batches):
        for table, starts in whole_groups(batches, ["key", "one", "other"]):
            node = table.column("node").to_numpy()
            sig = table.column("sig").combine_chunks().flatten().to_numpy().reshape(-1, COORDINATES)
            sizes = np.diff(np.append(starts, len(node)))
            two = starts[sizes == 2]
            near = (sig[two] == sig[two + 1]).sum(1) >= least
            a, b = [node[two[near]]], [node[two[near] + 1]]
            for s, n in zip(starts[sizes > 2], sizes[sizes > 2], strict=True):
                own = sig[s:s + n]
                root = roots(n, lambda i, rest, own=own: (own[rest] == own[i]).sum(1) >= least)
                moved = np.flatnonzero(root != np.arange(n))
                a.append(node[s + root[moved]])
                b.append(node[s + moved])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (a, b)], ["a", "b"])

    return run


def confirmed(percent: int):
    """Sorted candidate groups with full sets -> links that connect sets similar enough."""
    def run(batches):
        for table, starts in whole_groups(batches, ["key", "one", "other"]):
            node, raw = table.column("node").to_numpy(), table.column("set").to_pylist()
            a, b = [], []
            for s, e in zip(starts, np.append(starts[1:], len(node)), strict=True):
                sets = [np.frombuffer(r, np.uint64) for r in raw[s:e]]
                sizes = np.array([len(x) for x in sets])
                flat = np.unique(np.concatenate(sets), return_inverse=True)[1]
                begin = np.cumsum(sizes) - sizes
                mark = np.zeros(flat.max() + 1, bool)

                def linked(i, rest, flat=flat, begin=begin, sizes=sizes, mark=mark):
                    own = flat[begin[i]:begin[i] + sizes[i]]
                    mark[own] = True
                    n = sizes[rest]
                    first = np.cumsum(n) - n
                    at = np.repeat(begin[rest] - first, n) + np.arange(n.sum())
                    shared = np.add.reduceat(mark[flat[at]].astype(np.int64), first)
                    mark[own] = False
                    return 100 * shared >= percent * (n + sizes[i] - shared)

                root = roots(e - s, linked)
                moved = np.flatnonzero(root != np.arange(e - s))
                a.append(node[s + root[moved]])
                b.append(node[s + moved])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (a, b)], ["a", "b"])

    return run


def met_in_blocks(df: DataFrame, blocks: Column) -> DataFrame:
    """Rows of groups (key) dealt to pairs of blocks (one, other); each row goes to as many as there are.

    A group of one block is one pair of a block with itself, without copies.
    """
    own = F.pmod(F.xxhash64("node"), F.col("_blocks"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1))
    dealt = df.withColumn("_blocks", blocks.cast("long")).withColumn("_own", own).withColumn("_other", other)
    return dealt.withColumn("one", F.least("_own", "_other")).withColumn("other", F.greatest("_own", "_other")).drop(
        "_blocks", "_own", "_other")


def sorted_groups(df: DataFrame) -> DataFrame:
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(parts, "key", "one", "other").sortWithinPartitions("key", "one", "other", "node")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Per document (doc_id, text): n_shingles, component_id, kept, and row_hash.

    Documents whose shingle sets have ``percent`` of their union in common are linked;
    component_id is the smallest doc_id reachable. Equal sets are one class. A class posts itself
    under the values of its signature's coordinates, rarest first, and leaves out as many of the
    most frequent as a match may lack: two signatures with enough equal coordinates still meet, and
    passages that many documents share make no long lists. Members of a list are held against
    each other in its task; links that connect those with enough equal coordinates give candidate
    groups, whose full sets are then compared. Tasks return spanning links only, so a
    group of copies never becomes its pairs.

    Documents without words, null or empty, link with nothing, and are kept. Rows without a doc_id
    take part, and a component that has no other id has none. Repeated rows fall into one class;
    texts of any length count whole. An empty table gives an empty one; other columns are not read.
    """
    spark, work = docs.sparkSession, Work(docs.sparkSession, "minhash")
    ready = docs.select("doc_id", F.xxhash64("text").alias("row_hash"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    signs = ready.mapInArrow(signed(width), (
        f"doc_id {kind}, row_hash long, n_shingles long, print binary, sig array<int>"))
    signs = work.store(signs.withColumn("node", F.monotonically_increasing_id()), "signatures")
    classes = work.store(signs.where("print is not null").groupBy("print").agg(
        F.min("node").alias("node"), F.min("doc_id").alias("first")), "classes")
    chosen = signs.join(classes.select("node"), "node", "left_semi")

    key = F.posexplode("sig").alias("at", "value")
    posts = chosen.select("node", key).select("node", (
        F.shiftleft(F.col("at").cast("long"), 32) + F.col("value").cast("long") + (1 << 31)).alias("key"))
    often = posts.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    # Values that one class alone has count first in its order; they are posted nowhere.
    shared = posts.join(often.hint("merge"), "key").groupBy("node").agg(
        F.sort_array(F.collect_list(F.struct("n", "key"))).alias("posts"))
    prefix = F.slice("posts", 1, F.greatest(F.size("posts") - MATCHES + 1, F.lit(0)))
    lists = shared.select("node", F.explode(prefix).alias("p")).select("node", "p.key", "p.n")
    lists = lists.join(signs.select("node", "sig").hint("merge"), "node")
    near = work.store(sorted_groups(met_in_blocks(lists, F.ceil(F.col("n") / LIST_ROWS)))
                      .select("key", "one", "other", "node", "sig")
                      .mapInArrow(matched(MATCHES), "a long, b long"), "near")

    groups = work.store(components(work, near), "groups")
    members = groups.join(signs, "node").select(
        F.col("component").alias("key"), "node", "doc_id", "row_hash", "n_shingles")
    totals = members.groupBy("key").agg(F.sum("n_shingles").alias("total"))
    members = work.store(members.join(totals, "key"), "members")

    def filled(batches):
        for batch in batches:
            sets = [s.tobytes() for s in shingle_sets(batch.column("text"), width)]
            yield batch.drop_columns(["text"]).append_column("set", pa.array(sets, pa.binary()))

    texts = ready.alias("d").join(members.alias("m").hint("merge"), same("d", "m", "doc_id", "row_hash")).select(
        "m.key", "m.node", "m.total", "d.text")
    # Repeated rows of one class give its set more than once; one is enough.
    sets = texts.mapInArrow(filled, "key long, node long, total long, set binary")
    links = work.store(sorted_groups(met_in_blocks(sets, F.ceil(F.col("total") / GROUP_SHINGLES)))
                       .select("key", "one", "other", "node", "set")
                       .mapInArrow(confirmed(percent), "a long, b long"), "links")

    joined = components(work, links)
    named = classes.join(joined, "node").groupBy("component").agg(F.min("first").alias("component_id"))
    of_class = (classes.join(joined, "node", "left").join(named, "component", "left")
                .select("print", F.coalesce("component_id", "first").alias("component_id")))
    work.drop("near", "groups", "members", "links")
    component = F.coalesce("component_id", "doc_id")
    return signs.join(work.store(of_class, "per-class"), "print", "left").select(
        "doc_id", "n_shingles", component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.col("print").isNull()).alias("kept"), "row_hash")


def dedup_documents(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group, that of the smallest doc_id; all columns.

    Documents without words stay. Rows equal in doc_id and text stay or go together.
    """
    gone = near_duplicates(docs, width, percent).where("not kept").select("doc_id", "row_hash").distinct()
    on = F.col("d.doc_id").eqNullSafe(F.col("g.doc_id")) & (F.xxhash64("d.text") == F.col("g.row_hash"))
    return docs.alias("d").join(gone.alias("g").hint("merge"), on, "left_anti")
