"""k-best lists and cells with exact bounds."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from oddspark.operators import nearest as N
from oddspark.plans import search as H
from oddspark.sources.versions import Store


def by_hand(vectors, queries, k):
    out = []
    for q, v in queries:
        if v is None or not any(v):
            continue
        found = []
        for i, e in vectors:
            if e is not None and len(e) == len(v) and np.isfinite(e).all() and any(e):
                a, b = np.array(e), np.array(v)
                found.append((-round(float(a @ b / np.sqrt(a @ a) / np.sqrt(b @ b)), 9), i))
        out += [(q, i, -s, r + 1) for r, (s, i) in enumerate(sorted(found)[:k])]
    return sorted(out)


@pytest.fixture(scope="module")
def data():
    rng = random.Random(3)
    spots = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(9)]
    near = lambda s: [x + rng.gauss(0, 0.05) for x in s]
    vectors = [(f"v{k}", near(spots[k % 9])) for k in range(400)]
    # Copies, and vectors that are near to nothing or of another length.
    vectors += [(f"w{k}", vectors[0][1]) for k in range(30)] + [("x1", [0.0] * 6), ("x2", None), ("x3", [1.0, 2.0]),
                                                               ("x4", [float("inf")] + [0.0] * 5)]
    queries = [(k, near(spots[k % 9])) for k in range(25)] + [(90, [0.0] * 6), (91, vectors[0][1]), (92, [1.0, 2.0])]
    return vectors, queries


def frames(spark, data):
    return (spark.createDataFrame(data[0], "id string, embedding array<double>").repartition(5),
            spark.createDataFrame(data[1], "query_id long, vector array<double>").repartition(3))


def listed(df):
    return sorted((r["query_id"], r["id"], round(r["similarity"], 9), r["rank"]) for r in df.collect())


@pytest.mark.parametrize("k", [1, 7, 60])
def test_nearest_equals_a_plain_search(spark, data, k):
    assert listed(N.nearest(*frames(spark, data), k)) == by_hand(*data, k)


def test_vectors_stay_where_they_lie(spark, data):
    vectors, queries = frames(spark, data)
    found = N.nearest(vectors.filter("id <> 'none'"), queries, 4)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    # One list per task and query goes into the ranking; nothing is exploded or dealt before it.
    assert "Explode" not in plan and plan.count("RepartitionByExpression") + plan.count("Repartition ") <= 2
    lists = N.packed(N.usable(vectors, "embedding"), "id", "embedding").crossJoin(
        N.packed(N.usable(queries, "vector"), "query_id", "vector")).filter("id_width = query_id_width")
    made = lists.mapInArrow(N._k_best(4, *[N._types(d, c)[1] for d, c in ((queries, "query_id"), (vectors, "id"))]),
                            "query_id long, id string, similarity double")
    per_task = made.withColumn("task", F.spark_partition_id()).groupBy("task", "query_id").count()
    assert per_task.agg(F.max("count")).first()[0] == 4


def test_lists_merge_in_any_order(spark):
    rng = random.Random(1)
    rows = [(-rng.randrange(5) / 4, f"i{k}") for k in range(40)]
    one, two = N.Best(6), N.Best(6)
    one.offer("q", rows)
    for k in rng.sample(range(40), 40):
        two.offer("q", rows[k:k + 1])
    assert one.held == two.held == {"q": sorted(rows)[:6]} and two.least("q") == -sorted(rows)[5][0]
    assert two.least("other") == -np.inf


@pytest.mark.parametrize("k, sample", [(1, 12), (7, 40), (60, 1000), (500, 3)])
def test_cells_give_the_rows_of_a_full_scan(spark, tmp_path, data, k, sample):
    vectors, queries = frames(spark, data)
    cells = N.write_cells(vectors, Store(spark, str(tmp_path)), 6, sample)
    best, read = N.nearest_in_cells(cells, queries, k)
    assert listed(best) == [r for r in by_hand(*data, k) if r[0] != 92]
    n_read = {r["query_id"]: r["n_read"] for r in read.collect()}
    whole = sum(n for n, _ in cells.sizes.values())
    assert whole == 430 and len(cells.sizes) <= sample and max(n_read.values()) <= whole
    if k < 60:
        assert sum(n_read.values()) / len(n_read) < 0.5 * whole


def test_search_texts_in_cells(spark, tmp_path):
    terms = spark.createDataFrame([("Injection site pain",), ("Nausea",), ("Pancreatitis acute",)], "pt string")
    corpus = H.embed_terms(terms)
    cells = H.write_search_cells(corpus, Store(spark, str(tmp_path)))
    queries = H.query_vectors(spark, ["acute pancreatitis", "pain at injection site"])
    found, shares = H.search_in_cells(cells, queries, 1, 0.1)
    want = H.semantic_event_search(corpus, queries, 1, 0.1)
    columns = ["query", "pt", "rank"]
    assert sorted(map(tuple, found.select(*columns).collect())) == sorted(map(tuple, want.select(*columns).collect()))
    assert all(0 < r["share_read"] <= 1 for r in shares.collect()) and shares.count() == 2
    with pytest.raises(ValueError):
        N.write_cells(corpus.limit(0).select(F.col("pt").alias("id"), "embedding"), Store(spark, str(tmp_path)), 8)


def test_stored_vectors_are_refreshed_in_place(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    reactions = spark.createDataFrame([(1, "Nausea"), (2, "Ileus"), (3, None)], "primaryid long, pt string")
    assert H.refresh_stored_embeddings(reactions, store)
    assert not H.refresh_stored_embeddings(reactions, store)
    more = reactions.union(spark.createDataFrame([(4, "Vomiting")], reactions.schema))

    def only_new(texts, kind):
        assert texts == ["Vomiting"]
        return [[1.0] for _ in texts]

    assert H.refresh_stored_embeddings(more, store, encoder=only_new)
    assert sorted((r["pt"], len(r["embedding"])) for r in store.read("embeddings").collect()) == [
        ("Ileus", 1024), ("Nausea", 1024), ("Vomiting", 1)]
