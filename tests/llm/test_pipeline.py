"""The corpus pipeline, stage by stage, against the operators' brute-force versions."""

import importlib.util
import sys
from pathlib import Path

import pytest

import corpus_pipeline

sys.path.insert(0, str(Path(__file__).parent))
from test_native import brute_leaks, brute_lines  # noqa: E402
from test_simhash import brute_similar  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The rows before and after each stage."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "t")
        stage(spark, out[-1], SF).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def rows(df):
    return [(r.doc_id, r.text) for r in df.orderBy("doc_id").collect()]


def test_columns_stay(stages):
    assert all(x.columns == stages[0].columns for x in stages[:5])
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "simhash_near_dedup", "benchmark_decontamination", "best_fit_packing"]


def test_language_keeps_clean_documents(stages):
    kept = dict(rows(stages[1]))
    for d, text in rows(stages[0]):
        assert d in kept or not any(c.isalpha() for c in text or "") or len(text.split()) < 40


def test_lines(stages):
    assert dict(rows(stages[2])) == brute_lines(rows(stages[1]))
    assert all(r.n_chars == len(r.text) for r in stages[2].collect())


def test_near_duplicates(stages):
    before = rows(stages[2])
    assert {d for d, _ in rows(stages[3])} == {d for d, c in brute_similar(before).items() if d == c}


def test_leaks(spark, stages):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaked = {d for d, _ in brute_leaks(rows(stages[3]), items)}
    assert {d for d, _ in rows(stages[4])} == {d for d, _ in rows(stages[3])} - leaked


def test_packing(stages):
    from test_arrow_operators import check_packing

    from plateloom.llm.packing import LENGTHS

    check_packing(stages[5].collect(), {d: len(t.split()) + 1 for d, t in rows(stages[4])}, LENGTHS)


def test_run_gives_the_stages_rows(spark, stages):
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(map(tuple, stages[5].collect()))


def test_odd_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("*", "1 as fp", "2 as _lang", "3 as row", "4 as w", "5 as gone").limit(40)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        out.count()


def test_brute_forces_are_found():
    assert importlib.util.find_spec("test_native")
