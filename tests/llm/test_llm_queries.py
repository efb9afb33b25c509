"""Registered queries against their SQL, and the pipeline against a plain version of its rules."""

import os

import duckdb
import pytest

import corpus_pipeline
from tidemark.llm import registry, simhash_ball, suffix_dedup

TABLES = ("documents", "benchmark", "labels", "conversations", "pages", "embeddings")


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_matches_its_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    frame = registry.QUERIES[name](spark, sf)
    columns = sorted(frame.columns)
    expected = con.execute(f"SELECT {', '.join(columns)} FROM ({registry.SQL[name]})").fetchall()
    assert sorted(map(tuple, frame.select(*columns).collect()), key=repr) == sorted(expected, key=repr)


def test_all_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES) == list(range(1, 14))


def test_pipeline_stages_follow_each_other(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    held = [docs]
    for name, stage in corpus_pipeline.STAGES:
        held.append(stage(spark, held[-1], sf).cache())
    toxic_free, unique, cut, clean, encoded = held[1:]
    assert all(f.columns == docs.columns for f in held[:-1])
    ids = [{r.doc_id for r in f.select("doc_id").collect()} for f in held]
    assert ids[1] <= ids[0] and ids[2] <= ids[1] and ids[3] == ids[2] and ids[4] <= ids[3] and ids[5] == ids[4]
    classes = simhash_ball.near_duplicates(toxic_free).collect()
    assert ids[2] == {r.component_id for r in classes}
    again = suffix_dedup.dedup_suffixes(unique).select("doc_id", "kept").collect()
    left = {r.doc_id: bytes(r.kept).decode("utf-8", "ignore") for r in again}
    assert {r.doc_id: r.text for r in cut.collect()} == left
    assert encoded.count() == clean.count()


def test_pipeline_run_equals_its_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
    columns = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf).select(columns).collect())) == sorted(map(tuple, docs.select(columns).collect()))
    assert os.path.basename(corpus_pipeline.__file__) == "corpus_pipeline.py"
