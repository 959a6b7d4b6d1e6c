"""The registered queries: their columns, and their SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

from plateloom.llm import queries

SF = "/root/testdata/sf0.001"

#: Columns that the queries begin with.
COLUMNS = {
    "op2_language_id": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op4_exact_topk": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "bigint"},
    "op5_warc": {"page_id": "bigint", "payload_bytes": "bigint", "payload_digest": "string", "record_type": "string", "refers_to": "bigint"},
    "op6_lm_scoring": {"doc_id": "bigint", "held_out": "boolean", "n_tokens": "bigint", "n_known": "bigint", "train_tokens": "bigint", "base_score": "double", "score": "double"},
    "op7_suffix_dedup": {"doc_id": "bigint", "n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint", "kept_sha256": "string"},
    "op8_license_scan": {"doc_id": "bigint", "n_words": "bigint", "n_base": "bigint", "first_word": "bigint", "last_word": "bigint", "base_labels": "string", "labels": "string", "score": "double"},
    "op9_simhash_near_dedup": {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
}


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    found = con.execute(queries.ORACLES[name])
    columns = [d[0] for d in found.description]
    df = queries.QUERIES[name](spark, SF)
    assert sorted(columns) == sorted(df.columns)
    assert sorted(map(str, df.select(*columns).toPandas().itertuples(index=False, name=None))) == sorted(map(str, spark.createDataFrame(found.fetchall(), df.select(*columns).schema).toPandas().itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns(spark, name):
    df = queries.QUERIES[name](spark, SF)
    types = dict(df.dtypes)
    assert {c: types[c] for c in COLUMNS[name]} == COLUMNS[name]
    rows = {"op4_exact_topk": None, "op5_warc": "pages"}.get(name, "documents")
    if rows:
        assert df.count() == spark.read.parquet(f"{SF}/{rows}.parquet").count()
    if "score" in types and name not in ("op4_exact_topk", "op6_lm_scoring"):
        assert df.filter("score < 0 or score > 1 or score is null").count() == 0


def test_one_query_each():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES if n != "pipeline") == list(range(1, 11))
