"""Secrets in texts: fixed patterns, and values in credential contexts that would take many guesses."""

import re
from collections.abc import Callable, Iterator
from math import inf, log10

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddspark.llm.shared import Work

# The base patterns, in the order in which kinds are listed.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
LEAST_ASSIGNED = 12
KINDS = ["assign", "access", "hex", "guess"]

#: A word that announces a credential, a separator, and a value: in quotes up to the closing one, else up to a space or mark.
CONTEXT = re.compile(
    r"""(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credentials?|auth|bearer|login)"""
    r"""["']?\x20*(?::=|=>|[:=]|\x20is\x20)\x20*(?:"([^"\n]+)"|'([^'\n]+)'|([^\s"'<>,;]+))""", re.ASCII | re.IGNORECASE)
#: Digits of the number of guesses from which a value is taken for a secret.
LEAST_GUESSES = 10.0
#: Rows of one value are spread over this many slots, so that no task meets a common value alone.
SLOTS = 64

# Keys by rows as they lie on a keyboard, each row half a key further right.
KEY_ROWS = ["1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm"]
KEYS = {c: (row, 2 * at + row) for row, keys in enumerate(KEY_ROWS) for at, c in enumerate(keys)}
# Signs written for letters.
LEET = str.maketrans("4@310$57", "aaeiosst")
DATE = re.compile(
    r"(?:19|20)\d\d([-/._]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01])"
    r"|(?:0[1-9]|[12]\d|3[01])([-/._]?)(?:0[1-9]|1[0-2])\2(?:19|20)\d\d"
    r"|(?:0[1-9]|1[0-2])([-/._]?)(?:0[1-9]|[12]\d|3[01])\3(?:19|20)\d\d", re.ASCII)
YEAR = re.compile(r"(?:19|20)\d\d", re.ASCII)
LETTERS = re.compile(r"[^\W\d_]+")
SHORTEST_WORD, LONGEST_WORD, LONGEST_UNIT = 3, 24, 16

#: Digits of guesses for the kind of a segment, a start of a walk, a turn in it, a date, a year, a change of one letter.
SEGMENT, START, TURN, DAY, YEARS, CHANGE = log10(5), log10(47), log10(6), log10(365 * 120), log10(120), log10(2)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, stop) of the fixed patterns, in code points, by start and listed kind."""
    spans = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGNED]
    spans += [("access", *m.span()) for m in ACCESS.finditer(text)] + [("hex", *m.span()) for m in HEX.finditer(text)]
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


def values_in(text: str, spans: list[tuple[str, int, int]]) -> Iterator[tuple[int, int, str, bool]]:
    """(start, stop, value, whether it lies apart from all spans) of the values in credential contexts."""
    spans, at, reached = sorted(spans, key=lambda s: s[1]), 0, 0
    for m in CONTEXT.finditer(text):
        start, stop = m.span(m.lastindex)
        while at < len(spans) and spans[at][1] < stop:
            reached, at = max(reached, spans[at][2]), at + 1
        yield start, stop, m[m.lastindex], start >= reached


def pieces_of(value: str) -> set[str]:
    """All strings of letters in a value that might be words, as written and with signs read as letters."""
    low = value.lower()
    found = set()
    for form in {low, low.translate(LEET)}:
        for run in LETTERS.findall(form):
            for i in range(len(run) - SHORTEST_WORD + 1):
                found.update(run[i:j] for j in range(i + SHORTEST_WORD, min(len(run), i + LONGEST_WORD) + 1))
    return found


def _char(c: str) -> float:
    """Digits of guesses for one character of its class."""
    if "0" <= c <= "9":
        return 1.0
    if "a" <= c <= "z" or "A" <= c <= "Z":
        return log10(26)
    return log10(33) if c < "\x7f" else 2.0


def guess_cost(value: str, word_cost: dict[str, float]) -> float:
    """Decimal digits of the number of guesses of the cheapest way to cut a value into segments.

    Segments are words (``word_cost`` digits and one change for each capital or sign), dates and years,
    repeats of a unit, walks over neighbouring keys or through the alphabet, and characters
    tried one by one. ``closed[j]`` is the least cost of the first j characters; a brute-force
    span or a walk that is still open has a cost of its own, so the time grows with the length.
    """
    # Lower case may lengthen a character; such characters stay as they are.
    low = "".join(c.lower() if len(c.lower()) == 1 else c for c in value)
    plain = low.translate(LEET)
    chars = [_char(c) for c in value]
    summed = [0.0]
    for c in chars:
        summed.append(summed[-1] + c)
    fixed: dict[int, list[tuple[int, float]]] = {}
    for pattern, cost in ((DATE, DAY), (YEAR, YEARS)):
        at = pattern.search(low)
        while at:
            fixed.setdefault(at.end(), []).append((at.start(), cost + (CHANGE if at.end() - at.start() > 8 else 0)))
            at = pattern.search(low, at.start() + 1)
    changed = [value[i] != plain[i] for i in range(len(value))]
    changes = [0]
    for c in changed:
        changes.append(changes[-1] + c)
    same = [0] * (LONGEST_UNIT + 1)
    closed, brute, walk, ways = [0.0], inf, inf, set()
    for j in range(1, len(value) + 1):
        brute = min(brute, closed[j - 1] + SEGMENT) + chars[j - 1]
        best = brute
        if j > 1:
            steps = _ways(low[j - 2], low[j - 1])
            fresh = closed[j - 2] + SEGMENT + START + TURN
            walk = min(fresh, walk + (0.0 if ways & steps else TURN)) if steps else inf
            best, ways = min(best, walk), ways & steps or steps
        for start, cost in fixed.get(j, ()):
            best = min(best, closed[start] + SEGMENT + cost)
        for n in range(SHORTEST_WORD, min(LONGEST_WORD, j) + 1):
            cost = min(word_cost.get(low[j - n:j], inf), word_cost.get(plain[j - n:j], inf))
            if cost < inf:
                best = min(best, closed[j - n] + SEGMENT + cost + CHANGE * (changes[j] - changes[j - n]))
        for q in range(1, min(LONGEST_UNIT, j - 1) + 1):
            # Characters up to here that equal the one a unit before.
            same[q] = same[q] + 1 if value[j - 1] == value[j - 1 - q] else 0
            times = same[q] // q + 1
            if times > 1:
                start = j - times * q
                unit = min(summed[start + q] - summed[start], word_cost.get(low[start:start + q], inf))
                best = min(best, closed[start] + SEGMENT + unit + log10(times))
        closed.append(best)
    return closed[-1]


def _ways(a: str, b: str) -> set[tuple]:
    """The ways from one character to the next: over neighbouring keys, along the alphabet or the digits."""
    ways = set()
    if a in KEYS and b in KEYS:
        down, right = KEYS[b][0] - KEYS[a][0], KEYS[b][1] - KEYS[a][1]
        if 0 < abs(down) + abs(right) <= 2:
            ways.add((down, right))
    if abs(ord(a) - ord(b)) == 1 and ("a" <= min(a, b) <= max(a, b) <= "z" or "0" <= min(a, b) <= max(a, b) <= "9"):
        ways.add(("next", ord(b) - ord(a)))
    return ways


SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64())])
VALUE = pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("value", pa.string()), ("apart", pa.bool_())])


def _scanned(batches):
    for batch in batches:
        base, values = [], []
        for text in batch.column(1):
            text = text.as_py() or ""
            spans = base_spans(text)
            base.append([dict(zip(SPAN.names, s, strict=True)) for s in spans])
            values.append([dict(zip(VALUE.names, v, strict=True)) for v in values_in(text, spans)])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(base, pa.list_(SPAN)), pa.array(values, pa.list_(VALUE))], ["doc_id", "base", "found"])


def _pieces(batches):
    for batch in batches:
        for k, value in enumerate(batch.column(0).to_pylist()):
            words = sorted(pieces_of(value))
            take = pa.array([k] * len(words), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(take), batch.column(1).take(take), pa.array(words, pa.string())], ["value", "slot", "word"])


def _costed(least: float) -> Callable:
    def run(batches):
        for batch in batches:
            hard = []
            for value, words in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                costs = {w["word"]: w["cost"] for w in words or ()}
                hard.append(guess_cost(value, costs) >= least)
            yield batch.select(["value", "slot"]).filter(pa.array(hard, pa.bool_()))

    return run


def word_counts(docs: DataFrame, values: DataFrame) -> DataFrame:
    """word, n: how often a word stands in the texts, less what stands in the values themselves: a
    password that was copied a thousand times is no word."""
    def counted(df: DataFrame, text: str, sign: int) -> DataFrame:
        found = F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(r"(\p{L}+)"))
        return df.select(F.explode(found).alias("word")).where(
            F.length("word").between(SHORTEST_WORD, LONGEST_WORD)).withColumn("n", F.lit(sign))

    both = counted(docs, "text", 1).unionAll(counted(values, "value", -1))
    return both.groupBy("word").agg(F.sum("n").alias("n")).where("n > 0")


def find_secrets(docs: DataFrame, least: float = LEAST_GUESSES) -> DataFrame:
    """doc_id, spans (kind, start, stop in code points) of every whole text, by start and listed kind.

    Besides the base kinds there is ``guess``: a value after a word that announces a credential,
    apart from all base spans, whose guess cost has ``least`` digits or more. Words get their
    cost from their share among the words of all texts. Only the strings of letters in such values
    meet that vocabulary. Rows of a value are dealt over slots, so that neither a common value nor
    a common word in many values falls to one task.

    One row for every row of ``docs``, repeated rows and null ids included. Null and empty texts
    have no spans, an empty table has no rows; texts and values of any length are taken whole. Only
    doc_id and text are read, so other columns may have any name.
    """
    work = Work(docs.sparkSession, "secrets")
    read = docs.select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    scanned = read.mapInArrow(
        _scanned, f"doc_id {kind}, base array<struct<kind:string,start:bigint,stop:bigint>>, "
        "found array<struct<start:bigint,stop:bigint,value:string,apart:boolean>>")
    scanned = work.store(scanned.withColumn("node", F.monotonically_increasing_id()), "scanned")
    rows = scanned.select("node", F.explode("found").alias("f")).select("node", "f.*")
    rows = rows.withColumn("slot", F.pmod(F.xxhash64("node"), F.lit(SLOTS)).cast("int"))
    values = rows.where("apart").select("value", "slot").distinct()
    pieces = work.store(values.mapInArrow(_pieces, "value string, slot int, word string"), "pieces")
    counts = work.store(word_counts(read, rows.select("value")), "counts")
    total = counts.agg(F.sum("n")).scalar()
    needed = counts.join(pieces.select("word").distinct(), "word", "left_semi").select(
        "word", F.log10(total / F.col("n")).alias("cost"),
        F.explode(F.sequence(F.lit(0), F.lit(SLOTS - 1))).alias("slot"))
    met = pieces.join(needed, ["word", "slot"]).groupBy("value", "slot").agg(
        F.collect_list(F.struct("word", "cost")).alias("words"))
    told = values.join(met, ["value", "slot"], "left").select("value", "slot", "words")
    hard = told.mapInArrow(_costed(least), "value string, slot int")
    span = F.struct(F.lit("guess").alias("kind"), "start", "stop")
    more = rows.where("apart").join(hard, ["value", "slot"]).groupBy("node").agg(F.collect_list(span).alias("more"))
    place = F.array(*[F.lit(k) for k in KINDS])
    with_more = scanned.where(F.size("found") > 0).join(more, "node", "left").select(
        "doc_id", F.concat("base", F.coalesce("more", F.array().cast(more.schema["more"].dataType))).alias("spans"))
    ordered = F.array_sort("spans", lambda x, y: F.when(
        x["start"] != y["start"], F.signum(x["start"] - y["start"])).otherwise(
        F.array_position(place, x["kind"]) - F.array_position(place, y["kind"])).cast("int"))
    without = scanned.where(F.size("found") == 0).select("doc_id", F.col("base").alias("spans"))
    return with_more.select("doc_id", ordered.alias("spans")).unionAll(without)


def secret_report(docs: DataFrame) -> DataFrame:
    """Per document the number of spans of each base kind, a digest of the base spans, and all spans as text."""
    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(
            ":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")

    def number(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"] != "guess")
    return find_secrets(docs).select(
        "doc_id", number("assign"), number("access"), number("hex"),
        F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
