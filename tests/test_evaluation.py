import random
import re

import pytest
from pyspark.sql import functions as F

from oddspark import fixed_values as V
from oddspark import schemas
from oddspark.functions import text as X
from oddspark.plans import answers as H14
from oddspark.plans import validation as H13
from oddspark.sources.fixtures import known_signals, load_fixture


def violations(spark, texts, claims, negations=V.NEGATION_PHRASES):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    listed = F.array(*[F.lit(c) for c in claims])
    return [r[0] for r in df.orderBy("i").select(
        X.forbidden_claims_in(listed, F.col("t"), negations)).collect()]


def test_claims_and_denials(spark):
    far = "x" * 40
    assert violations(spark, [
        "la semaglutida causa nauseas", "no causa nauseas",
        f"no causa nauseas {far} causa nauseas", "causas", "", "causa",
    ], ["Causa"]) == [["Causa"], [], ["Causa"], [], [], ["Causa"]]


def test_claims_against_positions_in_random_texts(spark):
    rng = random.Random(11)
    parts = ["causa", "no causa", "é", "causás", ".", " ", "más seguro", "not cause", "xx", "_"]
    texts = ["".join(rng.choice(parts) + rng.choice([" ", " ", ""]) for _ in range(rng.randint(0, 25)))
             for _ in range(600)]
    claims = ["causa", "más seguro", "a.b"]
    want = []
    for text in texts:
        bad = []
        for claim in claims:
            spots = [m.span() for m in re.finditer(r"\b" + re.escape(claim) + r"\b", text)]
            if any(not any(n in text[max(0, s - 30):e + 30] for n in V.NEGATION_PHRASES)
                   for s, e in spots):
                bad.append(claim)
        want.append(bad)
    assert violations(spark, texts, claims) == want
    assert sum(map(len, want)) > 50


@pytest.mark.parametrize("text,cited", [("n=12", True), ("n = 3 casos", True), ("(n=\t7)", True),
                                        ("n: 12", False), ("n =", False)])
def test_citation(spark, text, cited):
    assert spark.range(1).select(X.regex_citation(F.lit(text))).first()[0] is cited


RULES = [
    dict(id="q1", category="open_signal", question="one", expected_tool="detect_signals",
         must_mention_pts=["Nausea", "Death", "Ileus"], forbidden_claims=["causa"]),
    dict(id="q2", category="edge_case", question="two", expected_tool="handle_invalid_drug"),
    dict(id="q3", category="open_signal", question="three", expected_tool="get_open_signals",
         must_mention_pts=[], forbidden_claims=[]),
    dict(id="q4", category="comparison", question="four", expected_tool="compare_drugs"),
]


def call(name):
    return {"turn": 1, "name": name, "arguments": "{}", "output_preview": ""}


ANSWERS = [
    dict(question="one", tool_calls=[call("detect_signals"), call("detect_signals")],
         final_answer="NÁUSEAS (n = 5) y mortalidad; no implica que causa nada", n_turns=2),
    dict(question="two", tool_calls=[], final_answer="no existe", n_turns=1),
    dict(question="three", tool_calls=[call("compare_drugs")], final_answer="hay sesgo n=1",
         n_turns=3, error="late"),
    dict(question="four", tool_calls=None, final_answer=None, n_turns=2, error=""),
]


@pytest.fixture(scope="module")
def scored(spark):
    rules = load_fixture(spark, RULES, schemas.ANSWER_RULES)
    answers = load_fixture(spark, ANSWERS, schemas.ANSWERS)
    return answers, rules


def test_scores(scored):
    scores = H14.score_answers(*scored)
    assert scores.columns == H14.SCORES
    by_id = {r["id"]: r for r in scores.collect()}
    one = by_id["q1"]
    assert one["tool_ok"] and one["called_tools"] == ["detect_signals"]
    assert one["mentioned_pts"] == ["Nausea", "Death"] and one["missing_pts"] == ["Ileus"]
    assert one["pt_coverage"] == pytest.approx(2 / 3)
    assert one["no_forbidden"] and one["has_n_citation"] and not one["has_limitation"]
    two = by_id["q2"]
    assert two["tool_ok"] and two["has_n_citation"] and two["has_limitation"]
    assert two["pt_coverage"] == 1.0 and two["no_forbidden"]
    three = by_id["q3"]
    assert three["tool_ok"] and three["has_limitation"] and three["pt_coverage"] == 1.0
    four = by_id["q4"]
    assert not four["tool_ok"] and not four["has_n_citation"] and four["called_tools"] == []


def test_strict_tools_resolve_aliases(scored):
    by_id = {r["id"]: r for r in H14.score_answers(*scored, strict_tools=True).collect()}
    assert not by_id["q3"]["tool_ok"] and by_id["q1"]["tool_ok"]


def test_answer_summary(scored, rows):
    scores = H14.score_answers(*scored)
    row = H14.summarize_answers(scores).first()
    assert row["total_questions"] == 4 and row["n_errors"] == 1
    assert row["tool_accuracy"] == 0.75 and row["avg_turns"] == 2.0
    assert row["avg_pt_coverage"] == pytest.approx((2 / 3 + 3) / 4)
    assert rows(H14.failed_answers(scores)) == [("q3", "late")]


def test_known_signals(spark):
    def signal(drug, event, ic, ema, bcpnn):
        return (drug, event, 5, 1, 1, 1, 2.0, 4.0, 3.0, 1.0, 9.0, ic, 0.1, ema, bcpnn)

    signals = spark.createDataFrame([
        signal("semaglutide", "Pancreatitis", 1.0, True, True),
        signal("semaglutide", "Pancreatitis acute", 2.0, False, False),
        signal("semaglutide", "Ileus", 1.0, False, True),
        signal("liraglutide", "Cholecystitis", None, True, False),
        signal("liraglutide", "Cholelithiasis", -1.0, False, False),
    ], schemas.SIGNALS)
    results = H13.validate_known_signals(known_signals(spark), signals)
    by_id = {r["id"]: r for r in results.collect()}
    assert len(by_id) == 11
    assert by_id["k05"]["best_match_pt"] == "Pancreatitis acute"
    assert [m["event_pt"] for m in by_id["k05"]["matches"]] == ["Pancreatitis acute", "Pancreatitis"]
    assert by_id["k05"]["status"] == "PRESENT-NOT-SIGNAL"
    assert by_id["k11"]["status"] == "DETECTED"
    assert by_id["k08"]["best_match_pt"] == "Cholelithiasis" and len(by_id["k08"]["matches"]) == 2
    assert by_id["k01"]["status"] == "MISSING" and by_id["k01"]["a"] is None
    summary = H13.detection_summary(results).first()
    assert tuple(summary) == (11, 3, 3 / 11, 0, 1, 1, 1 / 11, 0.0, 1 / 11)
