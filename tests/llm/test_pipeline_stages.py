"""Every stage of the pipeline against a plain version, over planted rejects, passages and copies."""

import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
from test_rules_and_lines import passages_by_hand
from tokenizers import Tokenizer

import corpus_pipeline
from oddspark.llm import quality, queries
from oddspark.llm.shared import Work


def words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


def planted():
    """(doc_id, text, lang, source)."""
    rng = random.Random(12)
    line = lambda: " ".join(rng.choice("abcdefghijklmnop") + str(rng.randrange(400)) for _ in range(8))
    passage, texts = [line() for _ in range(6)], []
    for k in range(130):
        own = [line() for _ in range(rng.randrange(3, 12))]
        if k % 5 == 0:
            own[2:2] = passage[k % 3:3 + k % 4]
        texts.append("\n".join(own))
    texts += [texts[3], texts[4] + " more", texts[7] + "\n" + line(), texts[8].upper()]
    texts += ["too short", "", None, "a b c d e " * 9, line() + "\n" + "# $ % & " * 9, line() + "!" * 30, (line() + "\n") * 9]
    texts += [" ".join(line() for _ in range(400))]
    return [(k, t, "en" if k % 3 else "de", ["x", "y", None][k % 7 % 3]) for k, t in enumerate(texts)]


def plain_quality(rows):
    rates = {}
    for k, text, lang, source in rows:
        text, w = text or "", words(text)
        windows = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
        n = Counter(windows)
        repeats = len({i + j for i, g in enumerate(windows) if n[g] > 1 for j in range(5)})
        full = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        share = lambda a, b: 1000 * a // b if b else 0
        rates[k] = (lang, source), len(w) < 10 or 100 * repeats > 20 * len(w), {
            "symbol_rate": share(sum(text.count(c) for c in quality.SYMBOLS), sum(map(len, w))),
            "repeat_rate": share(repeats, len(w)), "dup_line_rate": share(len(full) - len(set(full)), len(full)),
            "shout_rate": share(text.count("!"), len(w))}

    def limit(group, name):
        for fits in (lambda g: g == group, lambda g: g[0] == group[0], lambda g: True):
            v = sorted(r[name] - r[name] % 10 ** max(len(str(r[name])) - 2, 0) for g, _, r in rates.values() if fits(g))
            if len(v) >= quality.LEAST_GROUP:
                break
        q1, q3 = (v[-(-len(v) * p // 100) - 1] for p in (25, 75))
        return max(q3 + 3 * (q3 - q1), quality.FLOORS[name])

    return {k for k, (g, failed, r) in rates.items() if not failed and all(r[m] <= limit(g, m) for m in r)}


def plain_near(texts):
    sets = {k: {tuple(w[i:i + 5]) for i in range(max(len(w) - 4, 1))} for k, t in texts.items() if (w := words(t.lower()))}
    least = {k: k for k in sets}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    for _ in sets:
        for a, b in links:
            least[a] = least[b] = min(least[a], least[b])
    return {k for k in texts if least.get(k, k) == k}


def plain_mix(docs):
    db = duckdb.connect()
    db.register("documents", docs.select("doc_id", "source", "text").toArrow())
    taken = db.execute(f"SELECT doc_id, taken, size FROM ({queries.ORACLES['op5_source_mix']})").fetchall()
    return Counter({k: int(np.floor(t / s + 0.5)) for k, t, s in taken if s})


def plain_pieces(rows):
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    plain.encode_special_tokens = True
    for k, t in rows:
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 2]
        first = len(ids) % 1024
        edges = ([0] if first else []) + list(range(first, len(ids) + 1, 1024))
        for n, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
            yield k, n, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())


def test_every_stage_equals_a_plain_version(spark, documents):
    rows, work = planted(), Work(spark, "test-stages")
    docs, after = documents(rows), {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, work.store(stage(spark, docs, "unused"), name.replace(" ", "-"))
        after[name] = before, docs
    read = {name: [(r.doc_id, r.text) for r in out.collect()] for name, (_, out) in after.items() if name != "packing"}

    kept = plain_quality(rows)
    assert sorted(read["quality rules"]) == sorted((k, t) for k, t, _, _ in rows if k in kept)
    assert {k for k, _, _, _ in rows} - kept >= set(range(134, 141)) and len(kept) > 120

    want = {k: t for k, (t, _) in passages_by_hand(read["quality rules"]).items()}
    assert dict(read["line dedup"]) == want and len(read["line dedup"]) == len(want)
    assert sum(want[k] != t for k, t in read["quality rules"]) > 15

    near = plain_near(want)
    assert sorted(read["near-dedup"]) == sorted((k, want[k]) for k in near) and len(near) < len(want)

    copies = plain_mix(after["mixing"][0])
    assert Counter(k for k, _ in read["mixing"]) == +copies and set(read["mixing"]) <= set(read["near-dedup"])
    assert len(set(copies.values())) > 1

    packed = docs.collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed) == sorted(plain_pieces(read["mixing"]))
    ends = Counter()
    for r in sorted(packed, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends[r.sequence_id] and r.offset + r.length <= 1024
        ends[r.sequence_id] += r.length
