import math

import pytest

from oddspark.operators.upsert import upsert_by_key
from oddspark.plans import search as H


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [("same", [1.0, 0.0, 0.0]), ("half", [1.0, 1.0, 0.0]), ("none", [0.0, 0.0, 2.0]),
            ("opposite", [-3.0, 0.0, 0.0]), ("zero", [0.0, 0.0, 0.0]), ("tie", [2.0, 2.0, 0.0])]
    return spark.createDataFrame(rows, "pt string, embedding array<float>")


@pytest.fixture(scope="module")
def queries(spark):
    return spark.createDataFrame([("q", [2.0, 0.0, 0.0]), ("z", [0.0, 0.0, 1.0])],
                                 "query string, vector array<float>")


@pytest.mark.parametrize("packed", [256, 1])
def test_similarities(corpus, queries, packed):
    found = {(r["query"], r["pt"]): r["similarity"]
             for r in H.similarities(corpus, queries, packed).collect()}
    assert len(found) == 12
    assert found[("q", "same")] == pytest.approx(1.0)
    assert found[("q", "half")] == pytest.approx(1 / math.sqrt(2))
    assert found[("q", "none")] == 0.0
    assert found[("q", "opposite")] == pytest.approx(-1.0)
    assert found[("q", "zero")] is None and found[("z", "none")] == pytest.approx(1.0)


def test_bound_applies_after_the_top_k(corpus, queries):
    best = H.semantic_event_search(corpus, queries, 3).orderBy("query", "rank").collect()
    assert [(r["query"], r["pt"], r["rank"]) for r in best] == [
        ("q", "same", 1), ("q", "half", 2), ("q", "tie", 3), ("z", "none", 1)]
    assert H.semantic_event_search(corpus, queries, 30, -1.0).count() == 10
    with pytest.raises(ValueError):
        H.semantic_event_search(corpus, queries, 31)


def test_embedding_of_missing_terms(spark, tmp_path):
    reactions = spark.createDataFrame(
        [(1, "Nausea"), (2, "Nausea"), (3, None), (4, "Ileus"), (5, "Vomiting")],
        "primaryid long, pt string")
    stored = H.embed_terms(reactions.filter("pt = 'Ileus'"))
    assert sorted(r[0] for r in H.missing_terms(reactions, stored).collect()) == [
        "Nausea", "Vomiting"]
    new = H.embed_missing(reactions, stored)
    merged = upsert_by_key(stored, new, ["pt"]).collect()
    assert sorted(r["pt"] for r in merged) == ["Ileus", "Nausea", "Vomiting"]
    assert {len(r["embedding"]) for r in merged} == {1024}


def test_refreshing_embeds_each_term_once(spark, tmp_path):
    one, two = str(tmp_path / "v1"), str(tmp_path / "v2")
    first = spark.createDataFrame([(1, "Nausea"), (2, "Ileus")], "primaryid long, pt string")
    H.refresh_embeddings(first, str(tmp_path / "none"), one)
    more = first.union(spark.createDataFrame([(3, "Vomiting")], first.schema))

    def only_new(texts, kind):
        assert texts == ["Vomiting"]
        return [[1.0] for _ in texts]

    H.refresh_embeddings(more, one, two, only_new)
    stored = {r["pt"]: len(r["embedding"]) for r in spark.read.parquet(two).collect()}
    assert stored == {"Nausea": 1024, "Ileus": 1024, "Vomiting": 1}


def test_encoder_batches(spark):
    def counting(texts, kind):
        assert len(texts) <= 128 and kind == "query"
        return [[float(len(texts)), float(t)] for t in texts]

    terms = spark.range(300).selectExpr("cast(id as string) as pt").coalesce(1)
    found = H.embed_terms(terms, counting, "query").collect()
    assert all(r["embedding"][1] == float(r["pt"]) for r in found)
    assert sorted({r["embedding"][0] for r in found}) == [44.0, 128.0]


def test_search_by_text(spark):
    terms = spark.createDataFrame([("Injection site pain",), ("Nausea",), ("Pancreatitis acute",)],
                                  "pt string")
    queries = H.query_vectors(spark, ["acute pancreatitis", "pain at injection site"])
    best = H.semantic_event_search(H.embed_terms(terms), queries, 1, 0.1).collect()
    assert {(r["query"], r["pt"]) for r in best} == {
        ("acute pancreatitis", "Pancreatitis acute"),
        ("pain at injection site", "Injection site pain")}
