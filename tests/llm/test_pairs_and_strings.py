"""Near-duplicates, vectors and repeated strings against brute force."""

import hashlib
import random

import numpy as np

from oddspark.llm import covertree, minhash, suffixes


def smallest(n, links):
    label = list(range(n))
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return label


def edited(words, rate, rng):
    return [rng.choice("abcdefgh") * 3 if rng.random() < rate else w for w in words]


def shingles(text, width):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = low.split(" ") if low else []
    w = [x for x in w if x]
    return {tuple(w[k:k + width]) for k in range(max(len(w) - width + 1, 1))} if w else set()


def test_near_duplicates_equal_brute_force(documents):
    rng = random.Random(5)
    texts = []
    for g in range(12):
        base = [f"g{g}w{k}" for k in range(rng.choice([6, 40, 150]))]
        texts += [" ".join(edited(base, rng.choice([0, 0.01, 0.03, 0.08]), rng)) for _ in range(rng.randrange(1, 14))]
    texts += ["one", "One", "two words", None, "", "   ", "Straße ÄÖ é a b c", "STRAßE ÄÖ é a b c"]
    docs = documents(list(enumerate(texts)))
    got = {r.doc_id: r for r in minhash.near_duplicates(docs, width=4).collect()}
    sets = [shingles(t, 4) for t in texts]
    links = [(a, b) for a in range(len(sets)) for b in range(a) if sets[a] and sets[b]
             and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    label = smallest(len(texts), links)
    assert [got[k].component_id for k in range(len(texts))] == label
    assert [got[k].n_shingles for k in range(len(texts))] == [len(s) for s in sets]
    assert all(got[k].kept == (label[k] == k) for k in got)


def test_near_duplicates_of_odd_rows(documents):
    long = " ".join(str(k) for k in range(30_000))
    docs = documents([(1, long), (1, long), (2, long + " x"), (None, long), (None, None)])
    got = minhash.near_duplicates(docs).collect()
    assert [r.component_id for r in got if r.n_shingles] == [1, 1, 1, 1]
    assert sorted(r.doc_id or 0 for r in minhash.dedup_documents(docs).collect()) == [0, 1, 1]
    assert minhash.near_duplicates(documents([])).count() == 0


def test_blocks_give_the_same_links(documents, monkeypatch):
    base = [f"w{k}" for k in range(60)]
    docs = documents([(k, " ".join(base[:50] + [f"u{k % 7}", f"v{k}"])) for k in range(40)])
    monkeypatch.setattr(minhash, "LIST_ROWS", 7)
    monkeypatch.setattr(minhash, "GROUP_SHINGLES", 300)
    assert {r.component_id for r in minhash.near_duplicates(docs).collect()} == {0}


def test_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(25, 8))
    points = [(centres[k % 25] + rng.normal(size=8) * (0.05, 0.25, 0.6)[k % 3]).tolist() for k in range(300)]
    points += [points[0], [2 * x for x in points[1]], [1.0, 2.0], [2.0, 4.0]]
    odd = [None, [], [0.0] * 8, [float("nan")] * 8, [None] + [1.0] * 7, [float("inf")] + [1.0] * 7]
    table = [(k, p, 1, "x") for k, p in enumerate(points + odd)] + [(None, points[0], 1, "x")]
    df = spark.createDataFrame(table, "vec_id long, embedding array<double>, node int, v string")
    for block in (4096, 40):
        got = {r.vec_id: r for r in covertree.link_vectors(df, block=block).collect()}
        assert len(got) == len(table)
        n, links = len(points), []
        for a in range(n):
            for b in range(a):
                p, q = np.array(points[a]), np.array(points[b])
                if len(p) == len(q) and p @ q / np.sqrt((p @ p) * (q @ q)) >= 0.9:
                    links.append((a, b))
        label, count = smallest(n, links), np.bincount(np.array(links).ravel(), minlength=n)
        assert [got[k].component_id for k in range(n)] == label
        assert [got[k].n_links for k in range(n)] == count.tolist()
        assert all(got[k].kept and got[k].n_links == 0 and got[k].component_id == k for k in range(n, n + len(odd)))
    assert covertree.link_vectors(df.limit(0)).count() == 0


def test_repeated_strings_equal_brute_force(documents, monkeypatch):
    rng = random.Random(9)
    text = lambda n: "".join(rng.choice("abcdé") for _ in range(n))
    shared, passage = text(260), text(700)
    texts = [text(300) + shared + text(50), shared + text(10), text(90) + passage[100:520], passage, passage,
             "z" * 450, text(199), text(150) + shared[:199], None, "", shared[20:240] * 2, passage[:205] + text(3) + passage[300:505]]
    raw = [(t or "").encode() for t in texts]
    at = {}
    for d, b in enumerate(raw):
        for i in range(len(b) - 199):
            at.setdefault(b[i:i + 200], []).append((d, i))
    for bucket in (1_000_000, 50):
        monkeypatch.setattr(suffixes, "BUCKET", bucket)
        got = {r.doc_id: r for r in suffixes.dedup_strings(documents(list(enumerate(texts)))).collect()}
        for d, b in enumerate(raw):
            gone = bytearray(len(b))
            for i in range(len(b) - 199):
                if len(at[b[i:i + 200]]) > 1:
                    gone[i:i + 200] = b"\1" * 200
            kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
            spans = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
            assert (got[d].n_bytes, got[d].n_removed, got[d].n_spans) == (len(b), sum(gone), spans), d
            assert got[d].kept_sha256 == hashlib.sha256(kept).hexdigest() and bytes(got[d].kept) == kept
    assert suffixes.dedup_strings(documents([])).count() == 0


def test_the_cover_meets_every_distance():
    assert {(a - b) % suffixes.PERIOD for a in suffixes.COVER for b in suffixes.COVER} == set(range(suffixes.PERIOD))
