"""Toxicity, url models, archives and packing."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from oddspark.llm import packing, toxicity, urls, warc
from oddspark.llm.shared import Work


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(1)
    emit, move = rng.normal(size=5), rng.normal(size=(2, 2))
    marginal, _ = toxicity.forward_backward(emit, np.array([0, 3]), np.array([3, 2]), move)
    for start, n in ((0, 3), (3, 2)):
        sums = np.zeros((n, 2))
        for code in range(2 ** n):
            tags = [(code >> k) & 1 for k in range(n)]
            score = sum(emit[start + k] * t for k, t in enumerate(tags)) + sum(move[a, b] for a, b in zip(tags, tags[1:], strict=False))
            for k, t in enumerate(tags):
                sums[k, t] += np.exp(score)
        assert np.allclose(sums[:, 1] / sums.sum(1), marginal[start:start + n])


def test_long_chains_are_not_cut():
    """Marginals and pair sums of chains of any length equal those of a plain walk over 2 x 2 sums."""
    rng = np.random.default_rng(2)
    lengths = np.array([1, 64, 65, 700, 3, 128, 129])
    starts = np.cumsum(lengths) - lengths
    emit, move = 2 * rng.normal(size=lengths.sum()), rng.normal(size=(2, 2))
    marginal, pairs = toxicity.forward_backward(emit, starts, lengths, move, np.ones(len(emit)))
    step, want_pairs = np.exp(move), np.zeros((2, 2))
    for start, n in zip(starts, lengths, strict=True):
        score = np.stack([np.ones(n), np.exp(emit[start:start + n])], 1)
        ahead, back = score.copy(), np.ones((n, 2))
        for k in range(1, n):
            ahead[k] *= ahead[k - 1] @ step
            ahead[k] /= ahead[k].sum()
        for k in range(n - 1, 0, -1):
            back[k - 1] = step @ (score[k] * back[k])
            back[k - 1] /= back[k - 1].sum()
        both = ahead * back
        assert np.allclose(both[:, 1] / both.sum(1), marginal[start:start + n])
        for k in range(1, n):
            joint = ahead[k - 1][:, None] * step * (score[k] * back[k])[None, :]
            want_pairs += joint / joint.sum()
    assert np.allclose(pairs, want_pairs)
    ids, ends = np.zeros(5000, int), np.zeros(5000, bool)
    assert [x.tolist() for x in toxicity.chained(ids, ends)] == [[0], [5000]]


def test_held_out_toxic_documents_are_found(spark, documents):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    rows, marks = [], []
    for k in range(400):
        words = [word() for _ in range(30)]
        if k % 4 == 0:
            words[rng.randrange(30)] = "zzbad" + rng.choice(["", "ly", "ness,"])
        rows.append((k, " ".join(words)))
        marks.append((k, 1, int(k % 4 == 0)))
    rows += [(1000, None), (1001, ""), (1002, "zzbad " * 5000), (None, "fine words")]
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.score_toxicity(documents(rows), labels).collect()}
    held = [k for k in range(400) if zlib.crc32(str(k).encode()) % 4 == 2]
    assert all(got[k].held_out == (k in held) for k in range(400))
    assert np.mean([got[k].predicted == (k % 4 == 0) for k in held]) > 0.97
    assert got[1000].score == got[1001].score == 0 and got[1002].predicted == 1
    some = next(got[k] for k in held if k % 4 == 0)
    span = some.spans[0]
    assert rows[some.doc_id][1][span.first:span.stop] == span.text and span.text.startswith("zzbad")
    assert {r.score for r in toxicity.score_toxicity(documents(rows[:5]), labels.limit(0)).collect()} == {0.0}
    assert toxicity.score_toxicity(documents([]), labels).count() == 0


def test_a_sampled_document_gives_one_text_however_many_rows_it_has(spark, documents, monkeypatch):
    seen = []
    monkeypatch.setattr(toxicity, "fitted", lambda texts, marks: seen.append((texts, marks.tolist())))
    ids = [k for k in range(20) if zlib.crc32(str(k).encode()) % 4 != 2]
    rows = [(k, f"text {k}") for k in ids] + [(ids[0], "text 0 other")] + [(ids[1], f"text {ids[1]}")] * 300 + [(90, None)] * 3
    labels = spark.createDataFrame([(k, k % 2) for k in [*ids, 90]], "doc_id long, toxic int")
    toxicity.train(documents(rows), labels)
    order = [k for label in toxicity.SAMPLE for k in [*ids, 90] if k % 2 == label and zlib.crc32(str(k).encode()) % 4 != 2]
    assert seen == [([f"text {k}" if k != 90 else "" for k in order], [k % 2 for k in order])]


@pytest.mark.parametrize("url, host, path, rule", [
    ("http://A.Net/x", "a.net", "/x", "net/"), ("https://m.example.net/en/9?q", "m.example.net", "/en/9", "example.net/en/"),
    ("https://anet.com/", "anet.com", "/", None), ("x://b.org/fr/#a", "b.org", "/fr/", "org/fr/"), ("http://c.net", "c.net", "", None),
    (None, "", "", None), ("no scheme.net/", "", "", None), ("a://h?x://y.net/", "h", "", None)])
def test_rules(spark, url, host, path, rule):
    row = urls.ruled(spark.createDataFrame([(1, url)], "page_id long, url string")).first()
    assert (row.host, row.path, row.rule) == (host, path, rule)


def test_url_scores_equal_a_plain_model(spark):
    good, bad = ["http://a.org/fr/kit", "http://b.org/fr/tik"], ["http://c.net/spam", "http://d.net/maps"]
    table = [(u, 1, 1) for u in good] + [(u, 0, 1) for u in bad]
    import pyarrow as pa
    batch = pa.RecordBatch.from_pylist([{"url": u, "accepted": a, "fold": f} for u, a, f in table])
    cells = next(iter(urls.counted([batch])))
    model = urls.Ratio(cells.column("cell").to_numpy(), cells.column("n").to_numpy())

    def chance(texts, context, symbol):
        p = 1 / urls.SYMBOLS
        for k in range(urls.ORDER + 1):
            ctx = context[len(context) - k:] if k <= len(context) else "\0" * (k - len(context)) + context
            follow = []
            for t in texts:
                padded = "\0" * urls.ORDER + t
                follow += [padded[i] for i in range(urls.ORDER, len(padded)) if padded[i - k:i] == ctx]
            if follow:
                p = (follow.count(symbol) + len(set(follow)) * p) / (len(follow) + len(set(follow)))
        return p

    probe = "http://e.org/spa"
    want = np.mean([np.log(chance(good, probe[:i], c) / chance(bad, probe[:i], c)) for i, c in enumerate(probe)])
    assert model.scores(pa.array([probe, "", None]))[0] == pytest.approx(want, rel=1e-4)
    assert model.scores(pa.array(["", None])).tolist() == [0, 0]


def test_every_url_context_is_counted_exactly(spark):
    rng = random.Random(6)
    path = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(40))
    names = [f"http://{h}/{path()}" for h in ("a.org/fr", "c.net", "e.edu") for _ in range(250)]
    names += names[:40] + ["http://" + "x/" * 500]
    got = urls.judge_urls(spark.createDataFrame(list(enumerate(names)), "page_id long, url string")).collect()
    follow = {}
    for u in names:
        if ("a.org/fr" in u or "c.net" in u) and zlib.crc32(u.encode()) % 4:
            padded = "\0" * urls.ORDER + u
            for i in range(urls.ORDER, len(padded)):
                for k in range(urls.ORDER + 1):
                    one = follow.setdefault(("a.org/fr" in u, padded[i - k:i]), {})
                    one[padded[i]] = one.get(padded[i], 0) + 1
    assert len(follow) > 4 * 4096

    def log(accepted, padded, i):
        p = 1 / urls.SYMBOLS
        for k in range(urls.ORDER + 1):
            if one := follow.get((accepted, padded[i - k:i])):
                p = (one.get(padded[i], 0) + len(one) * p) / (sum(one.values()) + len(one))
        return np.log(p)

    assert sorted(r.page_id for r in got) == list(range(len(names)))
    for r in got:
        padded = "\0" * urls.ORDER + names[r.page_id]
        want = np.mean([log(True, padded, i) - log(False, padded, i) for i in range(urls.ORDER, len(padded))])
        assert r.score == pytest.approx(want, abs=1e-7)


def test_urls_of_odd_rows(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, ""), (None, "http://x.net/" + "y" * 90_000)], "page_id long, url string")
    got = urls.judge_urls(df).collect()
    assert len(got) == 4 and {r.verdict for r in got} == {"allow", "block"}
    assert urls.judge_urls(df.limit(0)).count() == 0


def test_archives_round_trip(spark):
    big = "<p>é" + "x" * 2000
    rows = [(1, "http://a/", big), (2, "http://b/\r\nX: y", big), (3, None, "short"), (4, "u", "short"), (5, "v", None), (None, "w", big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r for r in warc.round_trip(pages).collect()}
    assert [got[k].record_type for k in (1, 2, 3, 4, 5, None)] == ["revisit", "response", "response", "response", "response", "revisit"]
    assert got[1].refers_to == 2 and got[2].refers_to is None and got[5].payload_bytes == 0
    assert got[1].payload_bytes == got[2].payload_bytes == len(big.encode()) and got[1].payload_digest == got[2].payload_digest
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_archive_filters_skip_payloads(spark, monkeypatch):
    work = Work(spark, "warc-test")
    folder = f"{work.path}/a"
    pages = spark.createDataFrame([(k, f"http://{k}/", f"page {k}" * 300) for k in range(6)], "page_id long, url string, html string")
    warc.write_pages(pages, folder)
    reader = warc.WarcReader(warc.READ, {"path": folder})
    from pyspark.sql.datasource import EqualTo, GreaterThan
    other = GreaterThan(("payload_length",), 3)
    assert list(reader.pushFilters([EqualTo(("target_uri",), "http://3/"), other])) == [other]
    decoded = []
    real = warc.body_of
    monkeypatch.setattr(warc, "body_of", lambda h, b: decoded.append(h) or real(h, b))
    found = [row for p in reader.partitions() for row in reader.read(p)]
    assert len(found) == len(decoded) == 1 and found[0][-1] == b"page 3" * 300
    read = spark.read.format("warc").load(folder)
    assert read.where(F.col("target_uri").startswith("http://4")).select("payload").first()[0] == b"page 4" * 300


def test_plain_and_foreign_archives(tmp_path):
    records = [warc.record("response", f"<urn:page:{k}>", "u", None, "d", b"body%d" % k, "t") for k in range(3)]
    (tmp_path / "a.warc").write_bytes(b"".join(records))
    import gzip
    (tmp_path / "b.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in records))
    reader = warc.WarcReader(warc.READ, {"path": str(tmp_path)})
    found = [row for p in reader.partitions() for row in reader.read(p)]
    assert sorted(r[-1] for r in found) == [b"body0", b"body0", b"body1", b"body1", b"body2", b"body2"]


def test_no_record_of_an_archive_gets_lost(tmp_path):
    import gzip
    records = [warc.record("response", f"<urn:page:{k}>", f"u{k}", None, "d", b"body%d" % k * 9000, "t") for k in range(4)]

    def read(name, data, body=True, keep=lambda h: True):
        (tmp_path / name).write_bytes(data)
        with open(tmp_path / name, "rb") as raw:
            return [h["warc-target-uri"] for h, _ in warc.Stream(raw, len(data)).records(keep, body)]

    whole, some = gzip.compress(b"".join(records)), lambda h: h["warc-target-uri"] in ("u1", "u3")
    mixed = gzip.compress(b"".join(records[:3])) + gzip.compress(records[3])
    for data in (whole, mixed, b"".join(records)):
        for body in (True, False):
            assert read("a", data, body) == ["u0", "u1", "u2", "u3"] and read("a", data, body, some) == ["u1", "u3"]
    plain = records[0] + b"torn\r\n" + records[1]
    for data in (plain, gzip.compress(plain), whole[:-30], records[0][:-500], gzip.compress(records[0][:-500])):
        for body in (True, False):
            with pytest.raises(ValueError):
                read("b", data, body)


def test_pieces_and_sequences(documents):
    rng = random.Random(8)
    texts = [" ".join(rng.choice(["the", "unbelievable", "ñandú", "x9", "it's", "<|endoftext|>"]) for _ in range(rng.randrange(900)))
             for _ in range(60)]
    texts += [None, "", " ", "a  b", " lead", "trail ", "tab\t \nmix\u00a0 z", "line\nline two\n", "w " * 5000, texts[0]]
    got = packing.pack_documents(documents(list(enumerate(texts)))).collect()
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    plain.encode_special_tokens = True
    want = []
    for k, t in enumerate(texts):
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 2]
        first = len(ids) % 1024
        edges = ([0] if first else []) + list(range(first, len(ids) + 1, 1024))
        want += [(k, n, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for n, (a, b) in enumerate(zip(edges, edges[1:], strict=False))]
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 1024
    assert len(by) <= -(-sum(r.length for r in got) // 1024) * 1.1 + 1
    assert packing.pack_documents(documents([])).count() == 0


def test_runs_across_ranges_equal_one_stack():
    rng = random.Random(3)
    for _ in range(50):
        parts = [(p, rng.randrange(5), rng.randrange(5)) for p in range(6)]
        stack, want = [], []
        for p, gaps, pieces in parts:
            want += [((p, g), stack.pop()) for g in range(gaps) if stack]
            stack += [(p, k) for k in range(pieces)]
        got = [((gp, first + k), (pp, last - 1 - k)) for _, gp, first, n, pp, last in packing.across(parts) for k in range(n)]
        assert sorted(got) == sorted(want)


def test_lost_and_doubled_attempts_are_in_no_manifest(spark, tmp_path):
    """An attempt whose message never came, one that broke off, a job that failed, and an overwrite."""
    folder = str(tmp_path)
    rows = lambda *names: iter([pa.RecordBatch.from_pylist([
        {"record_type": "response", "record_id": f"<urn:page:{n}>", "payload": b"x"} for n in names], pa.schema(
            [(c, pa.binary() if c == "payload" else pa.string()) for c in warc.WRITE.names]))])
    read = lambda: sorted(r.record_id for r in spark.read.format("warc").load(folder).collect())

    def broken():
        yield from rows("half")
        raise RuntimeError("lost")

    warc.register(spark)
    (tmp_path / "foreign.warc").write_bytes(warc.record("response", "<urn:page:f>", None, None, None, b"f", "t"))
    failed = warc.WarcWriter({"path": folder}, False)
    failed.write(rows("never"))
    writer = warc.WarcWriter({"path": folder}, False)
    writer.write(rows("1", "2"))
    with pytest.raises(RuntimeError):
        writer.write(broken())
    writer.commit([writer.write(rows("1", "2")), None, writer.write(rows("3"))])
    assert read() == ["<urn:page:1>", "<urn:page:2>", "<urn:page:3>", "<urn:page:f>"]
    more = warc.WarcWriter({"path": folder}, False)
    gone = more.write(rows("5"))
    more.abort([gone, None])
    more.commit([more.write(rows("4"))])
    assert len(read()) == 5
    instead = warc.WarcWriter({"path": folder}, True)
    instead.commit([instead.write(rows("9"))])
    assert read() == ["<urn:page:9>"]
    held = [name for name, _ in warc.files_of(*warc.place(folder))]
    assert len(held) == 1 and not (tmp_path / "foreign.warc").exists()


def test_both_coders_give_the_same_ids(tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.json")
    ranks, plain = packing.byte_ranks(path), Tokenizer.from_file(path)
    plain.encode_special_tokens = True
    assert len(ranks) == 50256
    random.seed(8)
    letters = ["a", "e", "th", "ing", "é", "ß", "Ω", "中", "ſ", "ǅ", "ɐ", "\u1c8a", "\n", "\n\n", "\t", "\x85", "\u3000", "  ", " ", " ", " ",
               "'s", "'", ".", ",", "12", "<|endoftext|>", "😀", "\u0301", "\x1c", "_"]
    texts = ["".join(random.choices(letters, k=random.randint(0, 40))) for _ in range(600)]
    want = [e.ids for e in plain.encode_batch(texts, add_special_tokens=False)]
    for coder in (packing.Coder(path, ranks), packing.Coder(path)):
        flat, bounds = coder(pa.array(texts))
        assert [flat[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == want
    # A vocabulary whose tokens also come about in another way is left to the tokenizer.
    import json
    full = json.load(open(path, encoding="utf-8"))
    full["model"]["merges"][40000:40002] = full["model"]["merges"][40000:40002][::-1]
    (tmp_path / "t.json").write_text(json.dumps(full))
    assert packing.byte_ranks(str(tmp_path / "t.json")) is None
    full["normalizer"] = {"type": "NFC"}
    (tmp_path / "n.json").write_text(json.dumps(full))
    assert packing.byte_ranks(str(tmp_path / "n.json")) is None


def test_a_worker_builds_its_coder_once(monkeypatch, tmp_path):
    made, path = [], str(tmp_path / "tokenizer.json")
    (tmp_path / "tokenizer.json").write_bytes(open(public_tokenizers.path("byte_bpe_50k.json"), "rb").read())
    build = packing.Coder
    monkeypatch.setattr(packing, "Coder", lambda *a: made.append(a) or build(*a))
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2], "text": ["some words", None]})
    tasks = [list(packing.cut(path, packing.CAPACITY, packing.END)(iter([batch]))) for _ in range(3)]
    assert len(made) == 1 and all(t[0].equals(tasks[0][0]) for t in tasks)
