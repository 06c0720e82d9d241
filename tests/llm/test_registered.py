"""The registered queries over the smallest given tables."""

from __future__ import annotations

import os
import zlib

import duckdb
import pytest

import __spark_entry__ as entry_points
from newsflow.llm import substrings
from newsflow.llm.queries import ORACLES, QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
WHOLE = {1, 2, 4, 5, 7, 8, 10, 11, 12, 13}  # one row for each document


@pytest.fixture(scope="module")
def texts(spark):
    rows = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()
    return {r.doc_id: r.text or "" for r in rows}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, texts, name):
    assert name in entry_points.queries()
    rows = QUERIES[name](spark, SF_DIR).collect()
    number = int(name[2:].split("_")[0])
    if number in WHOLE:
        assert sorted(r.doc_id for r in rows) == sorted(texts)
    if number == 4:
        want = substrings.brute_force(list(texts.items()))
        assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in rows) == want
        duck = duckdb.connect()
        duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF_DIR}/documents.parquet'")
        said = duck.execute(ORACLES[name])
        columns = [c[0] for c in said.description]
        assert columns == ["doc_id", "n_words", "n_removed", "kept_sha256"] and sorted(said.fetchall()) == want
    if number == 7:
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
        assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    if number == 8:
        assert all(r.round_trip for r in rows)
    if number == 10:
        assert all(r.size == len(texts[r.doc_id].encode()) + 1 for r in rows)
        plan = QUERIES[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
