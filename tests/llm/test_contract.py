"""The registered queries against their SQL, and the pipeline's stages."""

import collections

import pytest

import __spark_entry__ as entry
import check
import corpus_pipeline
from hearsay.llm import queries
from hearsay.llm.tables import written


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_matches_sql(spark, sf_dir, name):
    with check.connect(sf_dir) as db:
        assert check.spark_result(queries.QUERIES[name](spark, sf_dir)) == check.sql_result(db, queries.SQL[name])


def test_one_query_per_operator():
    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert "pipeline" in entry.queries()


def test_pipeline_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, frames = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
        frames.append((name, docs))
    assert [n for n, _ in frames] == ["toxicity", "near_dedup", "pii", "mixing", "packing"]
    assert all(df.columns == columns for _, df in frames[:-1])
    rows = {n: df.collect() for n, df in frames}
    ids = {n: collections.Counter(r.doc_id for r in found) for n, found in rows.items()}
    assert ids["near_dedup"] == ids["pii"] and set(ids["pii"]) <= set(ids["toxicity"])
    assert set(ids["mixing"]) <= set(ids["pii"]) and max(ids["mixing"].values()) <= 2
    placed = collections.Counter(r.doc_id for r in rows["packing"] if r.piece == 0)
    assert placed == ids["mixing"]
    assert all(r.n_chars == len(r.text) for r in rows["pii"])


def test_pipeline_of_odd_rows(spark, odd_docs, no_docs, sf_dir):
    for docs in (odd_docs, no_docs):
        for name, stage in corpus_pipeline.STAGES:
            docs = written(stage(spark, docs, sf_dir), name)
        assert docs.count() >= 0
