"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals."""

import re
import string
import zlib
from array import array
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Labelled documents that the field is fitted on, per label: a bounded sample, by checksum of the
#: doc_id. Everything else is scored whole.
SAMPLE = {1: 800, 0: 2000}
#: A chain is a whole sentence, however long. Messages run along so many tokens of all chains at once;
#: a longer chain's blocks are joined by their transfer matrices, which gives the same marginals.
BLOCK = 64
BUCKETS = 1 << 20
LAST = BUCKETS - 1
MARKS = string.punctuation + "\u201c\u201d\u2018\u2019\u00ab\u00bb\u2026\u2013\u2014"
SPAN = 0.5


def features(token: str) -> list[int]:
    """Hashed features of a token without marks around it: the word, its beginnings, and a constant."""
    word = token.strip(MARKS).lower().encode("utf-8", "surrogatepass")
    return [zlib.crc32(word) & LAST, 0, *[zlib.crc32(word[:n], n) & LAST for n in (4, 5, 6, 7) if len(word) > n]]


def beginnings(token: str) -> list[str]:
    """The word itself (with its end marked) and its beginnings, unhashed."""
    word = token.strip(MARKS).lower()
    return [word + "$", *[word[:n] for n in (4, 5, 6, 7) if len(word) > n]]


def chained(text_ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the chains: the end of a text or of a sentence ends one."""
    last = ends.copy()
    last[:-1] |= text_ids[1:] != text_ids[:-1]
    last[-1:] = True
    begin = np.flatnonzero(np.concatenate([[True], last[:-1]]))
    return begin, np.diff(np.concatenate([begin, [len(text_ids)]]))


def passed(odds: np.ndarray, scores: np.ndarray) -> np.ndarray:
    """Log-odds of 'toxic' behind a step (or several) with these scores of tag pairs."""
    return (np.logaddexp(scores[0, 1], odds + scores[1, 1]) - np.logaddexp(scores[0, 0], odds + scores[1, 0]))


def run_along(odds: np.ndarray, emit: np.ndarray, starts: np.ndarray, lengths: np.ndarray, move: np.ndarray) -> None:
    """Fill ``odds`` behind the first token of every stretch."""
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    for k in range(1, lengths[0] if len(lengths) else 0):
        at = starts[:np.searchsorted(-lengths, -k, "left")] + k
        odds[at] = emit[at] + passed(odds[at - 1], move)


def transfers(emit: np.ndarray, starts: np.ndarray, move: np.ndarray) -> np.ndarray:
    """Log scores (2 x 2 x blocks) from the tag before a block of BLOCK tokens to its last one."""
    tag = np.array([0.0, 1.0])[None, :, None]
    scores = move[:, :, None] + tag * emit[starts]
    for k in range(1, BLOCK):
        scores = np.logaddexp(scores[:, :1] + move[0][None, :, None], scores[:, 1:] + move[1][None, :, None])
        scores += tag * emit[starts + k]
    return scores


def messages(emit: np.ndarray, starts: np.ndarray, lengths: np.ndarray, move: np.ndarray) -> np.ndarray:
    """Forward log-odds of 'toxic' per token, its own score included.

    The first blocks of all chains are run token by token. Then the odds at the end of every
    further block follow from those at the end of the one before by the block's transfer scores,
    and at last all further blocks are run at once: about n / BLOCK steps for a chain of n tokens.
    """
    odds = np.array(emit, float)
    blocks = -(-lengths // BLOCK)
    of = np.repeat(np.arange(len(starts)), blocks)
    nth = np.arange(len(of)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    at = starts[of] + nth * BLOCK
    size = np.minimum(lengths[of] - nth * BLOCK, BLOCK)
    run_along(odds, emit, at[nth == 0], size[nth == 0], move)
    later = at[nth > 0]
    if len(later):
        inner = (nth > 0) & (size == BLOCK)
        order = np.argsort(nth[inner], kind="stable")
        ranks, whole = nth[inner][order], at[inner][order]
        scores = transfers(emit, whole, move)
        cuts = np.searchsorted(ranks, np.arange(1, blocks.max() + 1))
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            odds[whole[lo:hi] + BLOCK - 1] = passed(odds[whole[lo:hi] - 1], scores[:, :, lo:hi])
        odds[later] = emit[later] + passed(odds[later - 1], move)
        run_along(odds, emit, later, size[nth > 0], move)
    return odds


def forward_backward(emit: np.ndarray, starts: np.ndarray, lengths: np.ndarray, move: np.ndarray,
                     weight: np.ndarray | None = None):
    """Marginals of the tag 'toxic' per token; with weights also the sum of those of neighbouring tags.

    ``emit`` is the score of 'toxic' over 'clean' per token, ``move`` the 2 x 2 transition scores.
    Messages are kept as log-odds of 'toxic', which needs one number per token. Those from behind
    are the forward ones of the reversed chains.
    """
    emit = np.asarray(emit, float)
    ahead = messages(emit, starts, lengths, move)
    back = messages(emit[::-1], (len(emit) - starts - lengths)[::-1], lengths[::-1], move.T)[::-1] - emit
    marginal = 1 / (1 + np.exp(-np.clip(ahead + back, -500, 500)))
    pairs = np.zeros((2, 2))
    inner = np.ones(len(emit), bool)
    inner[starts] = False
    if weight is not None and inner.any():
        at = np.flatnonzero(inner)
        left, right = ahead[at - 1], emit[at] + back[at]
        logs = np.stack([np.full(len(at), move[0, 0]), right + move[0, 1], left + move[1, 0], left + right + move[1, 1]])
        logs -= logs.max(0)
        share = np.exp(logs)
        pairs = (weight[at] * share / share.sum(0)).sum(1).reshape(2, 2)
    return marginal, pairs


class Tagger:
    """A fitted field: a weight per feature bucket, and the transitions."""

    def __init__(self, weights: np.ndarray, move: np.ndarray):
        self.weights, self.move, self.known = array("f", weights.tolist()), move, {}

    def emissions(self, tokens: list[str]) -> np.ndarray:
        known, weights = self.known, self.weights
        if len(known) > 400_000:
            known.clear()
        out = []
        for t in tokens:
            score = known.get(t)
            if score is None:
                score = sum([weights[f] for f in features(t)])
                if len(t) < 100:
                    known[t] = score
            out.append(score)
        return np.array(out, float)

    def tagged(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.DictionaryArray]:
        """Per token of all texts: the text's number, the marginal of 'toxic', the token."""
        text_ids, ends, tokens = tokens_of(texts)
        if not len(text_ids):
            return text_ids, np.zeros(0), tokens
        emit = self.emissions(tokens.dictionary.to_pylist())[tokens.indices.to_numpy()]
        return text_ids, forward_backward(emit, *chained(text_ids, ends), self.move)[0], tokens


def tokens_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.DictionaryArray]:
    """The white-space tokens of all texts: text number, whether a sentence ends there, token."""
    lists = pc.utf8_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    text_ids = np.asarray(pc.list_parent_indices(lists))
    flat = pc.list_flatten(lists)
    full = pc.not_equal(flat, "")
    text_ids, flat = text_ids[np.asarray(full)], flat.filter(full)
    coded = pc.dictionary_encode(flat)
    stops = np.asarray(pc.match_substring_regex(coded.dictionary, r"[.!?]$"), bool)
    return text_ids, stops[coded.indices.to_numpy()], coded


def marks_in(parts: list[np.ndarray], labels: np.ndarray, names: list[list[str]]) -> set[str]:
    """The names of tokens that mark toxic documents; ``parts`` are the token codes of each."""
    held, after = {0: Counter(), 1: Counter()}, {}
    for label, part in zip(labels, parts, strict=True):
        held[int(label)].update({f for c in set(part.tolist()) for f in names[c]})
        if label == 1:
            for left, c in zip([-1, *part[:-1].tolist()], part.tolist(), strict=False):
                for f in names[c]:
                    after.setdefault(f, set()).add(left)
    toxic, clean = (max(int((labels == k).sum()), 1) for k in (1, 0))
    return {f for f, n in held[1].items() if len(after[f]) >= max(4, 0.015 * toxic) <= n
            and (n + 0.5) / toxic >= 25 * (held[0][f] + 0.5) / clean}


def token_labels(texts: list[str], labels: np.ndarray) -> tuple:
    """Weak labels per token: toxic if its word, or a beginning of it, marks toxic documents.

    Beginnings are judged by the words that are no marks themselves.

    A mark is held by 25 times as large a share of the toxic documents as of the others, and stands
    there after many different tokens: as many as 1.5 % of the toxic documents, four at least. The
    other words of a toxic text with many copies follow the same token in all copies.
    """
    text_ids, ends, tokens = tokens_of(pa.array(texts, pa.string()))
    kinds = [features(t) for t in tokens.dictionary.to_pylist()]
    marking = [beginnings(t) for t in tokens.dictionary.to_pylist()]
    index = tokens.indices.to_numpy()
    parts = np.split(index, np.searchsorted(text_ids, np.arange(1, len(texts))))
    marks = marks_in(parts, labels, [m[:1] for m in marking])
    marks |= marks_in(parts, labels, [[] if m[0] in marks else m[1:] for m in marking])
    hit = np.array([any(f in marks for f in fs) for fs in marking], bool)
    return text_ids, ends, tokens, kinds, hit[index] & (labels[text_ids] == 1)


def fitted(texts: list[str], labels: np.ndarray, rounds: int = 40, one_in: int = 8) -> Tagger | None:
    """The field that maximises the likelihood of the token labels, by gradients with own step sizes.

    All chains with a toxic token take part, and one in ``one_in`` of the rest, which count as many.
    """
    if len(texts) == 0 or len(set(labels.tolist())) < 2:
        return None
    text_ids, ends, tokens, kinds, gold = token_labels(texts, labels)
    if not gold.any():
        return None
    starts, lengths = chained(text_ids, ends)
    has = np.add.reduceat(gold.astype(int), starts) > 0
    taken = has | (np.arange(len(starts)) % one_in == 0)
    inside = np.repeat(taken, lengths)
    weight = np.repeat(np.where(has, 1, one_in)[taken], lengths[taken])
    lengths = lengths[taken]
    starts = np.cumsum(lengths) - lengths
    gold, index = gold[inside], tokens.indices.to_numpy()[inside]
    used, index = np.unique(index, return_inverse=True)
    kinds = [kinds[k] for k in used]
    kind_of = np.repeat(np.arange(len(kinds)), [len(k) for k in kinds])
    bucket = np.array([f for k in kinds for f in k])
    inner = np.ones(len(index), bool)
    inner[starts] = False
    at = np.flatnonzero(inner)
    wanted = np.bincount(2 * gold[at - 1] + gold[at], weight[at], 4).reshape(2, 2)
    weights, move = np.zeros(BUCKETS), np.zeros((2, 2))
    weights[0] = -4.0
    sums, move_sums = np.full(BUCKETS, 1e-8), np.full((2, 2), 1e-8)
    for _ in range(rounds):
        emission = np.bincount(kind_of, weights[bucket], len(kinds))
        marginal, pairs = forward_backward(emission[index], starts, lengths, move, weight)
        per_kind = np.bincount(index, weight * (gold - marginal), len(kinds))
        grad = np.bincount(bucket, per_kind[kind_of], BUCKETS) - 0.01 * weights
        sums += grad ** 2
        weights += 0.5 * grad / np.sqrt(sums)
        grad = wanted - pairs - 0.01 * move
        move_sums += grad ** 2
        move += 0.5 * grad / np.sqrt(move_sums)
    return Tagger(weights, move)


def score_spec(spans: bool) -> str:
    return "score double" + (", spans array<struct<first: int, stop: int, text: string>>" if spans else "")


def spans_in(text: str, marginal: np.ndarray) -> list[dict]:
    """Runs of tokens more likely toxic than not, as character offsets."""
    found = []
    for k, m in enumerate(x for x in re.finditer(r"\S+", text)):
        if k < len(marginal) and marginal[k] >= SPAN:
            if found and found[-1]["last"] == k - 1:
                found[-1].update(last=k, stop=m.end())
            else:
                found.append({"last": k, "first": m.start(), "stop": m.end()})
    return [{"first": s["first"], "stop": s["stop"], "text": text[s["first"]:s["stop"]]} for s in found]


def aggregated(text_ids: np.ndarray, marginal: np.ndarray, n: int) -> np.ndarray:
    """Document scores: the highest marginal of any token, 0 without tokens."""
    score = np.zeros(n)
    np.maximum.at(score, text_ids, marginal)
    return score


def score_texts(docs: DataFrame, model, spans: bool = True) -> DataFrame:
    """``docs`` (text and any columns) with score, and the toxic spans if asked for."""
    def run(batches):
        tagger = model.value
        for batch in batches:
            texts = batch.column("text")
            score, found = np.zeros(len(batch)), [[] for _ in range(len(batch))]
            if tagger is not None:
                text_ids, marginal, _ = tagger.tagged(texts)
                score = aggregated(text_ids, marginal, len(batch))
                if spans:
                    for k in np.flatnonzero(score >= SPAN):
                        lo, hi = np.searchsorted(text_ids, [k, k + 1])
                        found[k] = spans_in(texts[int(k)].as_py(), marginal[lo:hi])
            columns = [*batch.drop_columns(["text"]).columns, pa.array(score)]
            names = [n for n in batch.schema.names if n != "text"] + ["score"]
            if spans:
                kind = pa.list_(pa.struct([("first", pa.int32()), ("stop", pa.int32()), ("text", pa.string())]))
                columns, names = [*columns, pa.array(found, kind)], [*names, "spans"]
            yield pa.RecordBatch.from_arrays(columns, names)

    kept = T.StructType([f for f in docs.schema if f.name != "text"])
    return docs.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), score_spec(spans)]))


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: dict[int, int] = SAMPLE) -> Tagger | None:
    """Fit on ``sample`` documents per label that are not held out; others only get scored."""
    known = labels.where("toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.where(~held_out() & F.col("doc_id").isNotNull())
    texts, marks = [], []
    for label, most in sample.items():
        chosen = (known.where(F.col("toxic") == label).orderBy(F.crc32(F.col("doc_id").cast("string").cast("binary")), "doc_id")
                  .limit(most).select("doc_id"))
        # One row for each id, so that ids with many rows neither outweigh the sample nor fill the driver.
        rows = (docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
                .groupBy("doc_id").agg(F.min("text").alias("text")).orderBy("doc_id").collect())
        texts += [r["text"] or "" for r in rows]
        marks += [label] * len(rows)
    return fitted(texts, np.array(marks, int))


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, spans: bool = True) -> DataFrame:
    """doc_id, held_out, score, predicted, and the offending spans, for every whole text.

    The labels are of documents: words and beginnings that mark toxic ones label the tokens of a
    bounded sample, on which the field is fitted. A document's score is the highest marginal of
    its tokens. Its inputs are the text alone.

    Null and empty texts score 0, as do all without labelled documents of both kinds. Texts of any
    length are tagged whole, sentence by sentence. Repeated rows are scored each; a document with
    several labels is toxic if one says so. An empty table gives an empty one. Columns other than
    doc_id and text are not read.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    scored = score_texts(docs.select("doc_id", "text"), model, spans)
    return scored.select(
        "doc_id", held_out().alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"), *(["spans"] if spans else []))
