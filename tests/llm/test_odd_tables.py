"""Every operator and stage on tables that are empty, all null, or full of one row."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from plateloom.llm import decontam, language_id, license_scan, line_dedup, lm, packing, simhash, suffix_dedup

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
TABLES = {
    "empty": [],
    "null": [(None, None, None, None, None)] * 3,
    "null texts": [(i, None, "en", "s", 0) for i in range(5)],
    "null ids": [(None, "the same words again and again in one line\nand another line", "en", "s", 1)] * 4,
    "one row": [(1, "only one row here", "en", "s", 17)],
    "copies": [(i, "a line\nthat is there\nvery many\ntimes over and over and over again\n" * 3, "en", "src", 9) for i in range(300)],
    "blank": [(i, " \n\t" * i, "de", None, i) for i in range(6)],
    "symbols": [(1, "\x00\x01     \U0001f600 ,.;", "en", "s", 9), (2, "İSTANBUL ǅ ß ﬁ", "fr", "s", 4)],
}


@pytest.fixture(params=sorted(TABLES))
def docs(spark, request):
    return spark.createDataFrame(TABLES[request.param], SCHEMA)


def test_operators(spark, docs):
    n = docs.count()
    benchmark = spark.createDataFrame([(1, "the same words again and again"), (2, None), (None, "")], "item_id long, text string")
    assert language_id.identify(docs).count() == n
    assert line_dedup.dedup_lines(docs).count() == n
    assert license_scan.scan(docs).count() == n
    assert simhash.near_duplicates(docs).count() == n
    assert suffix_dedup.dedup_bytes(docs).count() == n
    assert lm.score_documents(docs).count() == n
    assert packing.pack_documents(docs).agg(F.sum("n_tokens")).first()[0] in ((None,) if n == 0 else (docs.select(F.sum(packing.word_count(F.col("text")))).first()[0],))
    assert decontam.contamination(docs, benchmark).count() >= 0


def test_pipeline_stages(spark, docs):
    now = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, SF)
        assert out.columns == docs.columns and out.count() <= now.count()
        now = out
    assert corpus_pipeline.STAGES[-1][1](spark, now, SF).count() >= 0
