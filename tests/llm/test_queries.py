"""The registered queries against their SQL, and the pipeline stage by stage."""

import duckdb
import pytest

import corpus_pipeline
from oddspark.llm import queries
from oddspark.llm.shared import Work, table

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    df = queries.QUERIES[name](spark, FOLDER)
    names = sorted(df.columns)
    result = db.execute(f"SELECT {', '.join(names)} FROM ({queries.ORACLES[name]})")
    want = sorted(map(repr, result.fetchall()))
    assert sorted(repr(tuple(r)) for r in df.select(*names).collect()) == want and want


def test_stages(spark):
    docs = table(spark, FOLDER, "documents")
    columns, work = docs.columns, Work(spark, "test-pipeline")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before, docs = docs, work.store(stage(spark, docs, FOLDER), str(k))
        assert docs.count() > 0, name
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
        ids = {r.doc_id for r in docs.select("doc_id").collect()}
        assert ids <= {r.doc_id for r in before.select("doc_id").collect()}
    assert len(corpus_pipeline.STAGES) == 5
