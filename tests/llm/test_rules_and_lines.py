"""Quality rules, line chunks and mixing: edge cases, and brute-force versions where SQL isn't used."""

import random
from collections import Counter

import pytest

from oddspark.llm import lines, mixing, quality

PROSE = " ".join(f"word{k}" for k in range(40))


def test_counts_of_edge_cases(documents):
    rows = [(1, None, "en", "a"), (2, "", None, None), (3, "a b c d e a b c d e x x x x x", "en", "a"),
            (4, "#one\n#one\n \n", "en", None), (5, PROSE, "en", "a"), (5, PROSE, "en", "a"), (None, PROSE * 300, "en", "a")]
    got = {(r.doc_id, r.n_words): r for r in quality.quality_rules(documents(rows)).collect()}
    assert got[1, 0].base_failed and not got[1, 0].kept and got[2, 0].word_chars == 0
    assert got[3, 15].n_repeat_words == 10 and got[3, 15].base_failed
    assert (got[4, 2].n_symbols, got[4, 2].n_dup_lines) == (2, 1)
    assert got[5, 40].kept and not got[5, 40].base_failed
    assert quality.quality_rules(documents(rows)).count() == 7
    assert quality.quality_rules(documents([])).count() == 0


def test_kept_documents_have_all_columns(documents):
    docs = documents([(1, PROSE, "en", "a"), (1, PROSE, "en", "a"), (2, "too short", "en", "a"), (None, PROSE, "en", "a")])
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and kept.count() == 3


def test_symbols_beyond_the_threshold_of_the_group_are_rejected(documents):
    noisy = " ".join(f"w{k}#$" for k in range(40))
    rows = [(k, PROSE + f" {k}", "en", "a") for k in range(60)] + [(99, noisy, "en", "a")]
    kept = {r.doc_id for r in quality.quality_rules(documents(rows)).where("kept").collect()}
    assert kept == set(range(60))


def chunks_by_hand(text):
    parts, at = text.split("\n"), 0
    import hashlib
    h = [int(hashlib.md5(x.encode()).hexdigest()[:8], 16) for x in parts]
    for i in range(1, len(parts) + 1):
        if i == len(parts) or (i >= 2 and (h[i - 2] % lines.PRIME * lines.BASE + h[i - 1]) % lines.PRIME % lines.ONE_IN == 0):
            yield at, i - at, "\n".join(parts[at:i])
            at = i


def test_repeated_chunks_go_but_the_first(documents, rows):
    random.seed(3)
    shared = [f"shared line {k}" for k in range(12)]
    texts = {k: "\n".join([f"own {k} {j}" for j in range(random.randrange(5))] + shared + [f"end {k}"]) for k in range(6)}
    table = [*texts.items(), (10, None), (11, ""), (12, "\n\n\n\n\n\n"), (13, "\n\n\n\n\n\n"), (0, texts[0])]
    got = {r.doc_id: r for r in lines.dedup_lines(documents(table)).collect()}
    seen, want = set(), {}
    for k in sorted(texts):
        kept = []
        for _, n, chunk in chunks_by_hand(texts[k]):
            if n < 2 or chunk not in seen:
                kept.append(chunk)
            seen.add(chunk)
        want[k] = "\n".join(kept)
    assert {k: got[k].text for k in texts} == want and any(want[k] != texts[k] for k in texts)
    assert got[10].text is None and got[10].n_lines == 0 and got[11].text == "" and got[12].n_removed == 0
    assert lines.dedup_lines(documents([])).count() == 0


def passages_by_hand(table):
    """Texts without every two adjacent lines of which an earlier copy exists that they don't overlap."""
    first, want = {}, {}
    for k, text in sorted(table):
        parts, gone = text.split("\n"), set()
        for i in range(len(parts) - 1):
            pair = tuple(parts[i:i + 2])
            if "".join(pair).strip(" "):
                at = first.setdefault(pair, (k, i))
                if at[0] != k or i > at[1] + 1:
                    gone |= {i, i + 1}
        want[k] = ("\n".join(p for i, p in enumerate(parts) if i not in gone), len(gone))
    return want


def test_passages_go_wherever_they_begin(documents):
    rng = random.Random(5)
    shared = [f"shared line {k}" for k in range(9)]
    table = [(k, "\n".join([f"own {k}"] + shared[k % 5:k % 5 + rng.randrange(2, 5)] + [f"end {k}"])) for k in range(1, 40)]
    table += [(50, "a\na\na\na\na"), (51, "x\n \n \n \n \ny"), (52, "\n".join(rng.choice("pqr") for _ in range(60))), (53, ""),
              (54, "own 1"), (55, "a\na")]
    want = passages_by_hand(table)
    docs = documents([*table, table[3], (60, None)])
    got = lines.dedup_passages(docs).collect()
    assert len(got) == len(table) + 2
    assert {r.doc_id: (r.text, r.n_removed) for r in got if r.doc_id != 60} == want
    assert want[50][0] == "a\na" and want[55][0] == "" and want[51][1] == 0
    assert {r.doc_id: (r.text, r.n_chars) for r in lines.cleaned(docs).collect() if r.doc_id != 60} == {
        k: (t, len(t)) for k, (t, _) in want.items()}
    assert lines.dedup_passages(documents([])).count() == 0


def test_the_pipelines_lines_go_by_chunks_first_then_by_what_their_boundaries_cut(documents, monkeypatch):
    rng = random.Random(8)
    body = [f"line {k}" for k in range(40)]
    table = [(1, "\n".join(body)), (2, "\n".join(["own", *body, "end"]))]
    table += [(k, "\n".join([f"a {k}", *body[k:k + rng.randrange(2, 20)], f"z {k}"])) for k in range(3, 30)]
    docs, windows, posted = documents(table), [], lines.window_rows
    chunked = {r.doc_id: r.n_removed for r in lines.dedup_lines(docs).collect()}
    monkeypatch.setattr(lines, "window_rows", lambda d, known: windows.append(d) or posted(d, known))
    got = {r.doc_id: r.text for r in lines.cleaned(docs).collect()}
    assert got == {k: t for k, (t, _) in passages_by_hand(table).items()}
    by_chunks = {r.doc_id: sum(c["n"] for c in r.gone or []) for r in windows[0].collect()}
    assert by_chunks == chunked and sum(chunked.values()) > 60
    left = {k: n - got[k].count("\n") - 1 for k, n in ((k, t.count("\n") + 1) for k, t in table)}
    assert sum(left.values()) > sum(chunked.values())


def test_new_columns_give_way(documents):
    docs = documents([(1, "a\nb")]).withColumnRenamed("key", "n_lines")
    assert lines.dedup_lines(docs).columns[-2:] == ["_n_lines", "n_removed"]
    assert lines.cleaned(docs).columns == docs.columns


@pytest.mark.parametrize("sizes", [[300, 20, 4, 50], [5, 5, 5], [1000, 1]])
def test_taken_words_come_near_the_targets(documents, sizes):
    rows, k = [], 0
    for s, n in enumerate(sizes):
        for _ in range(n):
            k += 1
            rows.append((k, "w " * (1 + k % 30), "en", f"s{s}" if s else None))
    rows += [(9001, None, "en", "s1"), (9002, "", "en", "s1"), (1, rows[0][1], "en", None)]
    got = mixing.mix_sources(documents(rows)).collect()
    assert len(got) == len(rows) and all(0 <= r.taken <= 3 * r.size for r in got)
    total = Counter()
    for r in got:
        total[r.target, r.source_size] += r.taken
    for (target, size), taken in total.items():
        assert target <= 3 * size and abs(taken - target) <= 3 * mixing.BLOCK_WORDS
    again = mixing.mix_sources(documents(rows)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_no_id_and_no_repeated_row_fills_a_shard(documents):
    rows = [(7, f"{k} " + "w " * 9, "en", "one id") for k in range(600)]
    rows += [(None, f"{k} " + "w " * 9, "en", "no id") for k in range(600)]
    rows += [(8, "w " * 10, "en", "one row")] * 640 + [(k, "", "en", "no words") for k in range(600)]
    docs = documents(rows)
    work = mixing.Work(docs.sparkSession, "mix")
    small = dict(shard_words=500, shard_rows=50, piece_words=50, piece_rows=10)
    got = mixing.mix_sources(docs, work=work, **small).collect()
    assert len(got) == len(rows) and all(0 <= r.taken <= 3 * r.size for r in got)
    again = mixing.mix_sources(docs.repartition(5), **small).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    total = Counter()
    for r in got:
        total[r.target, r.source_size] += r.taken
    assert len(total) == 4
    for (target, _), taken in total.items():
        assert abs(taken - target) <= 3 * mixing.BLOCK_WORDS
    shards = docs.sparkSession.read.parquet(f"{work.path}/shards").collect()
    assert max(s.shard_size for s in shards) < 6000 / 4
    for party in range(4):
        assert sum(s.party == party for s in shards) >= 9


def test_mixed_documents_repeat_whole_rows(documents):
    docs = documents([(k, "w " * 20, "en", "a" if k < 5 else "b") for k in range(100)])
    mixed = mixing.mixed_documents(docs)
    times = Counter(r.doc_id for r in mixed.collect())
    assert mixed.columns == docs.columns and max(times.values()) <= 3 and all(times[k] == 3 for k in range(5))
    assert mixing.mixed_documents(documents([])).count() == 0


def test_the_mix_keeps_columns_of_any_name(documents):
    docs = documents([(k, PROSE, "en", "a") for k in range(6)] + [(9, "", "en", "a"), (10, None, "en", "b")])
    docs = docs.withColumnsRenamed({"score": "_copy", "key": "copies"}).selectExpr("*", "1 AS copy_number")
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    assert {r.doc_id for r in mixed.collect()} == set(range(6))
    assert mixing.mixed_documents(docs.limit(0)).count() == 0
