"""Registered queries: SQL where there is some, and the pipeline stage by stage."""

import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from faregrid.llm import minhash, toxicity
from tests.llm import brute

MEDIUM = "/root/testdata/sf0.01"
NAMES = [f"op{n}_" for n in range(1, 14)]


def test_each_operator_has_one_query():
    names = list(entry.queries())
    assert [sum(x.startswith(n) for x in names) for n in NAMES] == [1] * 13 and "pipeline" in names


@pytest.mark.parametrize("name", [n for n in entry.oracle_sql() if n.startswith("op")])
def test_sql(spark, name):
    got = entry.queries()[name](spark, MEDIUM).toPandas()
    con = duckdb.connect()
    for table in ("documents", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{MEDIUM}/{table}.parquet'")
    want = con.execute(entry.oracle_sql()[name]).df()
    plain = lambda df: sorted(map(tuple, df[sorted(df.columns)].astype(str).to_numpy().tolist()))
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


def test_near_duplicates_of_the_whole_table(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{MEDIUM}/documents.parquet").collect()]
    got = {r["doc_id"]: r["component_id"] for r in entry.queries()["op3_near_duplicates"](spark, MEDIUM).collect()}
    assert got == brute.near_components(rows)


def test_repeats_of_the_whole_table(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{MEDIUM}/documents.parquet").collect()]
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in entry.queries()["op6_repeated_passages"](spark, MEDIUM).collect()}
    assert got == brute.without_repeats(rows)


def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet")
    columns = docs.columns
    outputs = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, MEDIUM).write.parquet(f"{tmp_path}/{name}")
        docs = outputs[name] = spark.read.parquet(f"{tmp_path}/{name}")
        assert name == "pack" or docs.columns == columns
    rows = {n: [(r["doc_id"], r["text"], r["source"]) for r in d.collect()] for n, d in outputs.items() if n != "pack"}
    start = spark.read.parquet(f"{MEDIUM}/documents.parquet")
    labels = spark.read.parquet(f"{MEDIUM}/labels.parquet")
    clean = {r["doc_id"] for r in toxicity.toxicity(start, labels).where("predicted = 0").collect()}
    assert {i for i, *_ in rows["toxicity"]} == clean
    first: dict = {}
    for i, t, _ in sorted(rows["toxicity"]):
        first.setdefault(brute.normalised_digest(t), i)
    assert sorted(i for i, *_ in rows["exact"]) == sorted(first.values())
    groups = brute.near_components([(i, t) for i, t, _ in rows["exact"]])
    assert sorted(i for i, *_ in rows["near"]) == sorted(set(groups.values()))
    drawn = Counter(i for i, *_ in rows["mix"])
    assert set(drawn) <= {i for i, *_ in rows["near"]} and max(drawn.values()) <= 3
    pieces = outputs["pack"].collect()
    assert Counter(r["doc_id"] for r in pieces if r["start"] == 0) == drawn
    sizes = Counter()
    for r in pieces:
        sizes[r["sequence_id"]] += r["length"]
    assert max(sizes.values()) <= 1024


def test_run_is_the_stages(spark):
    if os.environ.get("QUICK"):
        pytest.skip("quick")
    small = "/root/testdata/sf0.001"
    got = corpus_pipeline.run(spark, small)
    assert got.columns[:3] == ["doc_id", "start", "length"] and got.count() > 0
    assert corpus_pipeline.ORACLE_SQL is None and minhash.LEAST_PERCENT == 75
