"""Periodic runs, secrets and clusters: brute-force versions, and the cases that data may bring."""

import hashlib
import math
import random
import re
import zlib

import pytest

from oddspark.llm import clustering, periodic, queries, secrets
from oddspark.llm.shared import table

FOLDER = "/root/testdata/sf0.001"
SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def runs_by_hand(w):
    found = []
    for q in range(1, len(w) // 3 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            n = j + q - i
            if n >= max(24, 3 * q) and not any(
                    all(w[x] == w[x + p] for x in range(i, i + n - p)) for p in range(1, q)):
                found.append((i, n, q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def report_by_hand(doc_id, text):
    w, h = SPACE.findall(text or ""), zlib.crc32(str(doc_id).encode())
    n, g = len(w), h // 10
    if doc_id is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = runs_by_hand(w)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = None
    for s, n, q in runs:
        if best is None or n * best[2] > best[1] * q:
            best = (s, n, q)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
            sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)),
            sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_runs_equal_a_plain_search():
    random.seed(5)
    for _ in range(150):
        texts = []
        for _ in range(random.randint(0, 6)):
            letters = random.choice([1, 2, 3, 50])
            word = lambda: b"%d" % random.randrange(letters)  # noqa: E731, B023
            t = [word() for _ in range(random.randint(0, 40))]
            for _ in range(random.randint(0, 4)):
                unit = [word() for _ in range(random.choice([1, 2, 7, 8, 9, 10, 11, 13, 16, 17, 25, 40, 60]))]
                t += (unit * 9)[:int(len(unit) * random.choice([2.5, 3, 3.1, 4, 6]))]
                t += [word() for _ in range(random.randint(0, 5))]
            texts.append(t)
        assert periodic.found_runs(texts) == [runs_by_hand(t) for t in texts]


def test_run_query_equals_a_plain_version(spark):
    want = [report_by_hand(r.doc_id, r.text) for r in table(spark, FOLDER, "documents").collect()]
    got = [tuple(r) for r in queries.QUERIES["op11_periodic_runs"](spark, FOLDER).collect()]
    assert sorted(got) == sorted(want) and sum(r[1] > 0 for r in got) > 10


def test_runs_of_odd_rows(documents):
    unit = " ".join(f"w{k}" for k in range(500))
    rows = [(1, None), (2, ""), (3, " \t\n"), (None, "a " * 30), (4, "a " * 23), (4, "a " * 23), (5, "b c\r\n" * 24),
            (6, f"x {unit} " + f"{unit}\n" * 2 + "y"), (7, f"{unit} " * 60)]
    got = {(r.doc_id, len(r.collapsed)): r for r in periodic.periodic_runs(documents(rows)).collect()}
    assert sum(len(r.runs) for k, r in got.items() if k[0] in (1, 2, 3, 4)) == 0
    assert [tuple(r) for r in got[None, 1].runs] == [(0, 30, 1)]
    assert [tuple(r) for r in got[5, 3].runs] == [(0, 24, 1)]
    assert [tuple(r) for r in got[6, len(unit) + 4].runs] == [(1, 1500, 500)]
    assert [tuple(r) for r in got[7, len(unit)].runs] == [(0, 30000, 500)]
    assert periodic.run_report(documents(rows)).count() == len(rows)
    assert periodic.run_report(periodic.with_planted_runs(documents([]))).count() == 0


def test_a_run_with_most_periods_is_reported(documents):
    text = "a b " * 12 + "x " + "c " * 24 + "y " + "d " * 24
    row = periodic.run_report(documents([(1, text)])).collect()[0]
    assert (row.n_runs, row.start, row.length, row.period, row.exponent_milli) == (3, 25, 24, 1, 24000)


def base_by_hand(text):
    """Matches of the patterns as they are written down, those that fail dropped afterwards."""
    assign = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    spans = [("assign", m) for m in re.finditer(assign, text, re.ASCII) if len(m[2]) >= 12]
    spans += [("access", m) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    spans += [("hex", m) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    order = ["assign", "access", "hex"]
    return [f"{k}:{m.start()}:{m.end()}" for k, m in sorted(spans, key=lambda s: (s[1].start(), order.index(s[0])))]


def secret_row(doc_id, text):
    spans = base_by_hand(text or "")
    counts = [sum(s.startswith(k) for s in spans) for k in ("assign", "access", "hex")]
    return (doc_id, *counts, hashlib.sha256(",".join(spans).encode()).hexdigest())


def test_base_spans_equal_a_plain_version(spark, documents):
    random.seed(2)
    parts = ["password", "PassWD", "secret", "token", "apikey", "API_key", "=", ":", " ", '"', "'", "AKIA", "ABCD1234",
             "0123456789abcdef", "deadbeef", "é", "\n", "x" * 11, "ſecret", "K", "-", "a", "Z9"]
    rows = [(k, "".join(random.choices(parts, k=random.randint(0, 30)))) for k in range(400)]
    rows += [(None, "token=abcdefghijkl"), (1000, None), (1001, ""), (1001, ""), (1002, "é" * 50000 + "AKIA" + "A" * 14)]
    got = secrets.secret_report(documents(rows)).collect()
    assert sorted(tuple(r)[:5] for r in got if r.doc_id is not None) == sorted(
        secret_row(*r) for r in rows if r[0] is not None)
    assert {r.doc_id: r.spans for r in got}[1002] == "access:50000:50018"
    assert len(got) == len(rows) and secrets.secret_report(documents([])).count() == 0
    docs = table(spark, FOLDER, "documents")
    got = [tuple(r)[:5] for r in queries.QUERIES["op12_secret_scan"](spark, FOLDER).collect()]
    assert sorted(got) == sorted(secret_row(r.doc_id, r.text) for r in docs.collect())


def segment_costs(value, words):
    """All segments that the rules allow, with their cost; brute-force spans by their characters."""
    keys = secrets.KEYS
    low = value.lower()
    plain = low.translate(secrets.LEET)
    for i in range(len(value)):
        for j in range(i + 1, len(value) + 1):
            yield i, j, sum(map(secrets._char, value[i:j]))
            for form in (low, plain):
                if form[i:j] in words and secrets.SHORTEST_WORD <= j - i <= secrets.LONGEST_WORD:
                    yield i, j, words[form[i:j]] + secrets.CHANGE * sum(value[k] != plain[k] for k in range(i, j))
            if secrets.DATE.fullmatch(low[i:j]):
                yield i, j, secrets.DAY + (secrets.CHANGE if j - i > 8 else 0)
            if secrets.YEAR.fullmatch(low[i:j]):
                yield i, j, secrets.YEARS
            for q in range(1, min(secrets.LONGEST_UNIT, (j - i) // 2) + 1):
                if (j - i) % q == 0 and value[i:j] == value[i:i + q] * ((j - i) // q):
                    unit = min(sum(map(secrets._char, value[i:i + q])), words.get(low[i:i + q], math.inf))
                    yield i, j, unit + math.log10((j - i) // q)
    assert keys


def cost_by_hand(value, words):
    best = [0.0] + [math.inf] * len(value)
    for i, j, cost in sorted(segment_costs(value, words), key=lambda s: s[1]):
        best[j] = min(best[j], best[i] + secrets.SEGMENT + cost)
    return best[-1]


def test_guess_cost_is_the_least_over_all_segmentations():
    random.seed(4)
    words = {"sun": 2.0, "moon": 2.5, "sunmoon": 3.0, "pass": 1.5, "aos": 2.2}
    parts = ["sun", "Moon", "p4$$", "2019", "20190230", "2019-12-31", "x", "Q", "#", "ab", "ab", "zzz", "é", "7"]
    for _ in range(300):
        # No neighbouring keys or letters: walks have a test of their own.
        value = "".join(random.choices(parts, k=random.randint(0, 5)))
        if not any(secrets._ways(a, b) for a, b in zip(value.lower(), value.lower()[1:])):
            assert math.isclose(secrets.guess_cost(value, words), cost_by_hand(value, words)), value


def test_walks_words_and_repeats_are_cheap():
    words = {"password": 2.0, "dragon": 3.0}
    cost = lambda v: secrets.guess_cost(v, words)
    walk = secrets.SEGMENT + secrets.START + secrets.TURN
    assert all(math.isclose(cost(v), walk) for v in ("qwertyuiop", "abcdefghijkl", "9876543210"))
    assert math.isclose(cost("1qaz2wsx"), 2 * walk) or cost("1qaz2wsx") < 2 * walk
    assert cost("P4ssw0rd") < cost("dragon1999") < cost("20240131dragon") < secrets.LEAST_GUESSES
    assert min(map(cost, ("hG7#kq2Lx", "v8Jq2mXw0Zr"))) >= secrets.LEAST_GUESSES
    assert cost("") == 0 and cost("İ" * 3) > 0


def test_values_in_credential_contexts(documents):
    hard, easy = "hG7#kq2Lx!", "sunflower2020"
    prose = "the sunflower is required to stand in the sun and the sunflower turns to the sun again"
    rows = [(k, prose) for k in range(40)]
    rows += [(100, f"é my pwd: {hard} ok"), (101, f"login => '{hard}'"), (102, f"pwd: {easy}"), (103, "pwd: qwertyuiop"),
             (104, "password=Zk83jfLq02Xv pwd: hG7#kq2Lx!"), (105, "the token is required")]
    rows += [(200 + k, f"passphrase: {hard}") for k in range(150)]
    got = {r.doc_id: r.spans for r in secrets.secret_report(documents(rows)).collect()}
    assert got[100] == "guess:10:20" and got[101] == "guess:10:20"
    assert got[102] == got[103] == got[105] == got[0] == ""
    assert got[104] == "assign:0:21,guess:27:37"
    assert all(got[200 + k] == "guess:12:22" for k in range(150))


def test_copied_values_are_no_words(documents):
    rows = [(k, f"some words here\npwd: brindlewhisk{'' if k else ' and more'}") for k in range(300)]
    assert all(r.spans == "guess:21:33" for r in secrets.secret_report(documents(rows)).collect())


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, v string, cluster int, far int")


def clusters_by_hand(rows, k, rounds, dim):
    kept = [(i, [math.floor(64 * x) for x in e]) for i, e in rows
            if e is not None and len(e) == dim and all(x is not None and math.isfinite(x) for x in e)]
    key = lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1])
    centres = [v for _, v in sorted(kept, key=key)[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    own = lambda: [min(range(len(centres)), key=lambda c: (far(v, centres[c]), c)) for _, v in kept]
    for _ in range(rounds):
        number = own()
        for c in range(len(centres)):
            members = [v for n, (_, v) in zip(number, kept, strict=True) if n == c]
            if members:
                centres[c] = [sum(x) // len(members) for x in zip(*members, strict=True)]
    number = own()
    d = [far(v, centres[n]) for n, (_, v) in zip(number, kept, strict=True)]
    return [(i, n, x, sum(y for m, y in zip(number, d, strict=True) if m == n), sum(d),
             hashlib.sha256(",".join(map(str, centres[n])).encode()).hexdigest())
            for (i, _), n, x in zip(kept, number, d, strict=True)]


@pytest.mark.parametrize("n, spread", [(300, 2.0), (5, 1.0), (80, 0.02), (60, 1e5)])
def test_clusters_equal_a_plain_version(spark, rows, n, spread):
    random.seed(n)
    data = [(random.randrange(n), [random.randrange(-8, 9) / 8 * spread + (k % 3) * spread * 9 for _ in range(4)]) for k in range(n)]
    data += data[:3] + [(None, [0.0] * 4), (n, None), (n + 1, [1.0] * 3), (n + 2, [1.0, None, 1.0, 1.0]),
                        (n + 3, [1.0, math.inf, 1.0, 1.0]), (n + 4, [math.nan] * 4), (n + 5, [])]
    df = vectors(spark, [(*r, 1, "x", 2, 3) for r in data])
    exact = [(r.vec_id, r.embedding) for r in df.collect()]
    assert rows(clustering.cluster_vectors(df, 4, 3, 4)) == sorted(clusters_by_hand(exact, 4, 3, 4), key=repr)


def test_vectors_without_clusters(spark):
    assert clustering.cluster_vectors(vectors(spark, [])).count() == 0
    far = [(1, [3e38] * 4, 1, "x", 2, 3), (2, [0.5] * 4, 1, "x", 2, 3)]
    got = {r.vec_id: tuple(r)[1:3] for r in clustering.cluster_vectors(vectors(spark, far), 4, 3, 4).collect()}
    assert got == {1: (None, None), 2: (0, 0)}
    assert clustering.cluster_vectors(vectors(spark, far[:1]), 4, 3, 4).collect()[0].cluster is None


def test_bounds_spare_distances_where_vectors_stand_apart(spark):
    random.seed(1)
    data = [(k, [(k % 8) * 10 + random.random() for _ in range(4)], 1, "x", 2, 3) for k in range(400)]
    heard = []
    clustering.cluster_vectors(vectors(spark, data), 8, 3, 4, on_round=lambda n, m: heard.append(m / n))
    assert len(heard) == 3 and heard[0] <= 1.1 and max(heard) < 4
