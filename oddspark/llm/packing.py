"""Token sequences packed by best fit, in rounds of range-sorted sweeps."""

import functools
import json
import os
import zlib
from bisect import bisect_right

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddspark.llm.shared import Work

CAPACITY, END = 1024, 2
#: Pieces and gaps of a range that one task sweeps, about.
SWEPT = 200_000
#: A space beside other white space: there, words can't be cut out without their neighbours.
UNEVEN = r" [\s\p{Z}\x{85}\x{1c}-\x{1f}]|[\s\p{Z}\x{85}\x{1c}-\x{1f}] "


#: Letters beyond Latin: their classes may be newer than one of the two coders, so only one codes them.
BEYOND_LATIN = r"[^\x{0}-\x{24f}]"
#: How byte-level tokenizers part a text (a fixed value).
PARTS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in a byte-level vocabulary: printable ones for themselves, others from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def merged(parts: list[bytes], ranks: dict[bytes, int], below: int) -> list[bytes]:
    """Parts joined pair by pair, the lowest rank first, as long as one below the limit is left."""
    while True:
        pairs = [(ranks.get(a + b, below), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))]
        rank, i = min(pairs, default=(below, 0))
        if rank >= below:
            return parts
        parts = [*parts[:i], parts[i] + parts[i + 1], *parts[i + 2:]]


@functools.cache
def byte_ranks(path: str) -> dict[bytes, int] | None:
    """The vocabulary as byte strings, if joining the pair whose union has the smallest id is what the tokenizer does; else None.

    That holds for byte-level pair merging whose ids rise in the order of the merges, if every token, joined
    from its bytes by lower ranks alone, ends as the pair that it is listed with: inside the bytes of a
    token nothing else can then have come about.
    """
    with open(path, encoding="utf-8") as file:
        full = json.load(file)
    model, split = full["model"], full.get("pre_tokenizer") or {}
    plain = (model.get("type") == "BPE" and not model.get("dropout") and not model.get("ignore_merges")
             and not full.get("normalizer") and split.get("type") == "ByteLevel"
             and split.get("use_regex") and not split.get("add_prefix_space")
             and all(t["special"] for t in full.get("added_tokens", ())))
    if not plain:
        return None
    letters, special = byte_letters(), {t["content"] for t in full.get("added_tokens", ())}
    ranks = {bytes(letters[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    pairs = [tuple(bytes(letters[c] for c in part) for part in pair) for pair in pairs]
    ids = [ranks.get(a + b, -1) for a, b in pairs]
    singles = {bytes([b]) for b in range(256)}
    rising = all(x < y for x, y in zip(ids, ids[1:])) and len(ranks) == len(singles) + len(pairs) and singles <= ranks.keys()
    # A token's bytes are joined up to its own rank, and must come to the two parts it is listed with.
    agree = rising and all(merged([bytes([c]) for c in a + b], ranks, i) == [a, b] for (a, b), i in zip(pairs, ids))
    return ranks if agree else None


class Coder:
    """Ids of texts. Words recur, so each distinct one between single spaces is coded once a batch.

    The tokenizer never joins across such a space: a word with the space before it is coded as in its
    text. Texts with other white space around spaces are coded whole. With ``ranks`` (``byte_ranks``)
    Latin words go through the faster coder, which gives the same ids; others and vocabularies of another
    kind through the tokenizer.
    """

    def __init__(self, path: str, ranks: dict[bytes, int] | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        vocabulary = self.tokenizer.get_vocab()
        self.spaced = np.zeros(max(vocabulary.values()) + 1, bool)
        self.spaced[[i for token, i in vocabulary.items() if token.startswith("\u0120")]] = True
        self.quick = tiktoken.Encoding("bytes", pat_str=PARTS, mergeable_ranks=ranks, special_tokens={}) if ranks else None

    def coded_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of words that begin with a space each, where each word's begin, and how many each has.

        They are coded as long texts; as a space stands only before a word, an id whose token
        begins with one begins a word.
        """
        beyond = np.asarray(pc.match_substring_regex(words, BEYOND_LATIN))
        order = np.argsort(beyond, kind="stable")
        rows = words.take(pa.array(order)).to_pylist()
        parts = [rows[:len(rows) - int(beyond.sum())], rows[len(rows) - int(beyond.sum()):]]
        flat = np.concatenate([np.zeros(0, np.uint32), *[np.array(ids, np.uint32) for part in parts for ids in self.coded(
            ["".join(part[k:k + 5000]) for k in range(0, len(part), 5000)])]])
        first = np.flatnonzero(self.spaced[flat])
        begin, sizes = np.empty(len(words), np.int64), np.empty(len(words), np.int64)
        begin[order], sizes[order] = first, np.diff(np.append(first, len(flat)))
        return flat, begin, sizes

    def coded(self, texts: list[str]) -> list[list[int]]:
        if self.quick is None:
            return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        beyond = pc.match_substring_regex(pa.array(texts, pa.large_string()), BEYOND_LATIN).to_pylist()
        slow = iter(self.tokenizer.encode_batch_fast([t for t, b in zip(texts, beyond, strict=True) if b], add_special_tokens=False))
        return [next(slow).ids if b else self.quick.encode_ordinary(t) for t, b in zip(texts, beyond, strict=True)]

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and where each text's begin (one more entry than texts)."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        whole = np.flatnonzero(pc.match_substring_regex(texts, UNEVEN))
        lists = pc.split_pattern(texts, " ")
        owner, words = np.asarray(pc.list_parent_indices(lists)), pc.list_flatten(lists)
        first = np.ones(len(owner), bool)
        first[1:] = owner[1:] != owner[:-1]
        uneven = np.zeros(len(texts), bool)
        uneven[whole] = True
        uneven = uneven[owner]
        kept = ~(uneven | first)
        spaced = pc.binary_join_element_wise(
            pa.scalar("", pa.large_string()), words.filter(pa.array(kept)), pa.scalar(" ", pa.large_string()))
        known = pc.dictionary_encode(spaced)
        flat, begin, sizes = self.coded_words(known.dictionary)
        # First words have no space before them; they and uneven texts are coded one by one.
        alone = first & ~uneven
        single = self.coded(words.filter(pa.array(alone)).to_pylist() + texts.take(pa.array(whole)).to_pylist())
        lengths = np.array([len(c) for c in single], np.int64)
        begin = np.concatenate([begin, len(flat) + np.cumsum(lengths) - lengths])
        sizes = np.concatenate([sizes, lengths])
        flat = np.concatenate([flat, np.array([i for c in single for i in c], np.uint32)])
        rank = np.flatnonzero(alone)
        index = np.zeros(len(owner), np.int64)
        index[kept] = known.indices.to_numpy()
        index[rank] = len(known.dictionary) + np.arange(len(rank))
        used = kept | alone
        index = np.concatenate([index[used], len(known.dictionary) + len(rank) + np.arange(len(whole))])
        owner = np.concatenate([owner[used], whole])
        order = np.argsort(owner, kind="stable") if len(whole) else slice(None)
        owner, index = owner[order], index[order]
        n = sizes[index]
        stop = np.cumsum(n)
        ids = flat[np.repeat(begin[index] - (stop - n), n) + np.arange(n.sum())]
        per_text = np.bincount(owner, n, len(texts)).astype(np.int64)
        return ids, np.concatenate([[0], np.cumsum(per_text)])


@functools.cache
def coder_of(path: str, stamp: int, quick: bool) -> list[Coder]:
    """Where a worker keeps the coder of a file as of ``stamp``: building it takes longer than a small task's texts."""
    return []


def coder_in_worker(path: str, ranks: dict[bytes, int] | None) -> Coder:
    kept = coder_of(path, os.stat(path).st_mtime_ns, bool(ranks))
    if not kept:
        kept.append(Coder(path, ranks))
    return kept[0]


def cut(path: str, capacity: int, end: int, ranks: dict[bytes, int] | None = None):
    """Batches of (doc_id, text) -> a row per piece: doc_id, piece, start, length, ids_crc32, ids."""
    def run(batches):
        coder = coder_in_worker(path, ranks)
        for large in batches:
            for lo in range(0, large.num_rows, 4000):
                batch = large.slice(lo, 4000)
                flat, bounds = coder(batch.column("text"))
                rows, spans, data = [], [], []
                for k in range(batch.num_rows):
                    ids = np.append(flat[bounds[k]:bounds[k + 1]], np.uint32(end))
                    edges = list(range(len(ids) % capacity, len(ids) + 1, capacity))
                    edges = edges if edges[0] == 0 else [0, *edges]
                    for piece, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
                        rows.append(k)
                        raw = ids[a:b].astype("<u4").tobytes()
                        spans.append((piece, a, b - a, zlib.crc32(raw)))
                        data.append(raw)
                spans = np.array(spans, np.int64).reshape(-1, 4)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(spans[:, 0].astype(np.int32)),
                     *[pa.array(spans[:, k]) for k in (1, 2, 3)], pa.array(data, pa.binary())],
                    ["doc_id", "piece", "start", "length", "ids_crc32", "ids"])

    return run


SWEEP = "part int, what string, gap long, gap_size int, piece long, piece_size int, place long, rest int"


def swept(batches):
    """Matches within one sorted range: each gap takes the largest piece so far that fits, as often as one does.

    Ascending by size, pieces before gaps of the same size; stacks by size hold the pieces met, so
    a gap takes the nearest below, then the nearest below what is left of it. The last piece of a gap
    carries the rest. What finds no mate is returned with its place: gaps from the front, pieces
    by size.
    """
    part, stacks, sizes, found, early = TaskContext.get().partitionId(), {}, [], [], 0
    for batch in batches:
        for kind, size, name in zip(*[batch.column(c).to_pylist() for c in ("kind", "size", "id")], strict=True):
            if kind == 0:
                if not sizes or sizes[-1] != size:
                    sizes.append(size)
                    stacks[size] = []
                stacks[size].append(name)
            elif not sizes:
                found.append((part, "gap", name, size, None, None, early, None))
                early += 1
            else:
                room, taken = size, []
                while at := bisect_right(sizes, room):
                    fits = sizes[at - 1]
                    taken.append([part, "match", name, room, stacks[fits].pop(), fits, None, None])
                    room -= fits
                    if not stacks[fits]:
                        del sizes[at - 1]
                taken[-1][-1] = room
                found += taken
        yield records(found)
        found = []
    left = [(name, size) for size in sizes for name in stacks[size]]
    yield records([(part, "piece", None, None, name, size, k, None) for k, (name, size) in enumerate(left)])


def records(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32()]
    names = [x.split()[0] for x in SWEEP.split(", ")]
    columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names)


def across(counts: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, int, int]]:
    """Matches between ranges, as runs (run, gap part, first gap, length, piece part, last piece + 1).

    ``counts`` holds (part, gaps left, pieces left) in order; the same stack discipline on whole
    runs, so at most two per part.
    """
    stack, runs = [], []
    for part, gaps, pieces in counts:
        done = 0
        while gaps - done and stack:
            source, left = stack[-1]
            n = min(gaps - done, left)
            runs.append((len(runs), part, done, n, source, left))
            done += n
            stack[-1][1] -= n
            if not stack[-1][1]:
                stack.pop()
        if pieces:
            stack.append([part, pieces])
    return runs


def one_round(work: Work, state: DataFrame, turn: int, rows: int) -> DataFrame:
    """Match open pieces with open gaps; returns (what, id, size, bin, offset) after the round."""
    spark = state.sparkSession
    parts = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // SWEPT)))
    order = ["size", "kind", "id"]
    ranged = state.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    sweep = work.store(ranged.mapInArrow(swept, SWEEP), f"sweep-{turn}")
    left = sweep.where("what <> 'match'").groupBy("part").agg(
        F.sum(F.expr("int(what = 'gap')")).alias("g"), F.sum(F.expr("int(what = 'piece')")).alias("p"))
    runs = spark.createDataFrame(
        across([tuple(r) for r in left.orderBy("part").collect()]),
        "run int, gap_part int, first long, n long, piece_part int, last long")
    # The runs number at most two per partition.
    gaps = sweep.where("what = 'gap'").select("part", "gap", "gap_size", "place").join(
        F.broadcast(runs), F.expr("part = gap_part and place >= first and place < first + n"), "left").select(
        "gap", "gap_size", "run", (F.col("place") - F.col("first")).alias("at"))
    pieces = sweep.where("what = 'piece'").select("part", "piece", "piece_size", "place").join(
        F.broadcast(runs), F.expr("part = piece_part and place < last and place >= last - n"), "left").select(
        "piece", "piece_size", "run", (F.col("last") - 1 - F.col("place")).alias("at"))
    met = gaps.where("run is not null").join(pieces.where("run is not null"), ["run", "at"])
    matches = sweep.where("what = 'match'").select("gap", "gap_size", "piece", "piece_size", "rest").unionByName(
        met.select("gap", "gap_size", "piece", "piece_size", (F.col("gap_size") - F.col("piece_size")).alias("rest")))
    matches = matches.select(F.explode(F.array_compact(F.array(
        F.struct(F.lit("done").alias("what"), F.col("piece").alias("id"), F.col("piece_size").alias("size"),
                 F.col("gap").alias("bin"), (CAPACITY - F.col("gap_size")).alias("offset")),
        F.when(F.col("rest").isNotNull(), F.struct(
            F.lit("gap").alias("what"), F.col("gap").alias("id"), F.col("rest").alias("size"),
            F.col("gap").alias("bin"), F.lit(0).alias("offset")))))).alias("x")).select("x.*")
    none = [F.lit(0).cast("long").alias("bin"), F.lit(0).alias("offset")]
    open_gaps = gaps.where("run is null").select(
        F.lit("gap").alias("what"), F.col("gap").alias("id"), F.col("gap_size").alias("size"), *none)
    open_pieces = pieces.where("run is null").select(
        F.lit("piece").alias("what"), F.col("piece").alias("id"), F.col("piece_size").alias("size"), *none)
    after = matches.unionByName(open_gaps).unionByName(open_pieces).where("size > 0")
    after = work.store(after, f"round-{turn}")
    work.drop(f"sweep-{turn}")
    return after


def best_fit(pieces: DataFrame, work: Work) -> DataFrame:
    """(id, bin, offset) for pieces (id, length): bins of CAPACITY, filled without gaps from 0.

    A piece of more than half a bin opens one. Rounds then sort pieces and gaps by size, dealt by
    range; each gap takes the largest pieces below it that no nearer gap takes, within its
    range by a sweep, between ranges (one piece) by the places of what is left. Gaps shrink, and the next round
    begins. When no piece fits any gap, new bins are opened, as many as the open pieces fill.
    A round stores its outcome; the driver sees a few sums and two numbers per range.
    """
    spark, turn = pieces.sparkSession, 0
    half = F.col("length") * 2 > CAPACITY
    first = pieces.select(F.explode(F.when(half, F.array(
        F.struct(F.lit("done").alias("what"), "id", F.col("length").cast("int").alias("size"), F.col("id").alias("bin"), F.lit(0).alias("offset")),
        F.struct(F.lit("gap").alias("what"), "id", (CAPACITY - F.col("length")).cast("int").alias("size"), F.col("id").alias("bin"), F.lit(0).alias("offset")),
    )).otherwise(F.array(
        F.struct(F.lit("piece").alias("what"), "id", F.col("length").cast("int").alias("size"), F.lit(0).cast("long").alias("bin"), F.lit(0).alias("offset")),
    ))).alias("x")).select("x.*").where("size > 0")
    state = work.store(first, "round-0")
    done, opened, before = state.where("what = 'done'"), 0, None
    while True:
        n, words, least, gaps = state.agg(
            F.count(F.when(F.col("what") == "piece", 1)), F.sum(F.when(F.col("what") == "piece", F.col("size"))),
            F.min(F.when(F.col("what") == "piece", F.col("size"))),
            F.count(F.when(F.col("what") == "gap", 1))).first()
        if not n:
            return done.select("id", "bin", "offset")
        kind = F.when(F.col("what") == "piece", 0).otherwise(1)
        # Gaps too small for the smallest open piece are closed for good.
        live = state.where(f"what = 'piece' or what = 'gap' and size >= {least}").select(
            kind.alias("kind"), "size", "id")
        if n == before or not gaps:
            new = -(-words // CAPACITY)
            live = live.unionByName(spark.range(new).select(
                F.lit(1).alias("kind"), F.lit(CAPACITY).alias("size"), (-1 - opened - F.col("id")).alias("id")))
            opened, gaps = opened + new, gaps + new
        turn, before = turn + 1, n
        state = one_round(work, live, turn, n + gaps)
        done = done.unionByName(state.where("what = 'done'"))


def pack_documents(docs: DataFrame, tokenizer: str | None = None, end: int = END, with_ids: bool = False) -> DataFrame:
    """Per piece of every document (doc_id, text): its place in a sequence of at most 1024 tokens.

    A document is its ids and ``end``. Longer ones are cut into full pieces, of which the first may
    be shorter. Columns: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and the ids
    themselves (little-endian, 32 bit) if asked for.

    A null or empty text is the end token alone. Repeated rows and null doc_ids are documents like any
    other. Pieces of equal size are interchangeable, and go by their row number. Texts of any length
    are coded whole. An empty table gives an empty one; other columns are not read.
    """
    work = Work(docs.sparkSession, "packing")
    path = tokenizer or public_tokenizers.path("byte_bpe_50k.json")
    kind = docs.schema["doc_id"].dataType.simpleString()
    pieces = docs.select("doc_id", "text").mapInArrow(
        cut(path, CAPACITY, end, byte_ranks(path)),
        f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, ids binary")
    pieces = pieces if with_ids else pieces.drop("ids")
    pieces = work.store(pieces.withColumn("id", F.monotonically_increasing_id()), "pieces")
    placed = best_fit(pieces.select("id", "length"), work)
    return pieces.join(placed.hint("merge"), "id").select(
        *[c for c in pieces.columns if c not in ("id", "ids")], F.col("bin").alias("sequence_id"),
        F.col("offset").cast("long").alias("offset"), *(["ids"] if with_ids else []))
