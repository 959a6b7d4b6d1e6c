"""The language model against counts in plain Python."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from plateloom.llm import lm, queries


@pytest.mark.parametrize("top", [1, 60, 10**6, 2**63])
def test_elias_fano_round_trip(top):
    rng = np.random.default_rng(top % 1000)
    for n in (0, 1, 5, 1000):
        values = np.sort(rng.integers(0, top, n, endpoint=True, dtype=np.uint64))
        ef = lm.EliasFano(lm.unpack_arrays(np.frombuffer(lm.pack_arrays(lm.EliasFano.encode(values)), np.uint8)))
        if n:
            assert (ef[np.arange(n)] == values).all()
        asked = np.concatenate([values, rng.integers(0, top, 300, endpoint=True, dtype=np.uint64)])
        first = np.searchsorted(values, asked)
        expected = np.where((first < n) & (values[np.minimum(first, n - 1)] == asked), first, -1) if n else np.full(len(asked), -1)
        assert (ef.find(asked) == expected).all()


def test_elias_fano_is_compact():
    values = np.sort(np.random.default_rng(0).integers(0, 2**40, 100_000, dtype=np.uint64))
    assert len(lm.pack_arrays(lm.EliasFano.encode(values))) * 8 / 100_000 < 3.6 + math.log2(2**40 / 100_000)


def words(text):
    return [w for w in re.split("[ \t\n\x0b\f\r]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w] + [None]


def learned(d):
    return d is None or zlib.crc32(str(d).encode()) % 7 != 2


def brute(rows, train=None):
    """Counts of words, pairs and triples in plain Python, and the formulas of the docstrings."""
    train = [words(t) for d, t in rows if learned(d)] if train is None else [words(t) for t in train]
    c = Counter(w for t in train for w in t)
    n, v = sum(c.values()), len(c)
    c2, c3 = Counter(), Counter()
    for t in train:
        s = ["<s>", *t]
        c2.update(zip(s, s[1:]))
        c3.update(zip(s, s[1:], s[2:]))
    m2, m3 = lm.PRIORS
    quantised = lambda x: 2 ** (round(math.log2(x) * lm.STEPS) / lm.STEPS)
    uni = lambda w: (c[w] + 1) / (n + v + 1)

    def pair(a, w, p=uni):
        return (round(quantised(c2[a, w])) if c2[a, w] else 0) + m2 * p(w), c[a] + m2

    def given(a, b, w):
        top, bottom = pair(b, w)
        total = round(quantised(c2[a, b])) if c2[a, b] else 0
        share = 1 / quantised((c2[a, b] + m3) / c3[a, b, w]) if c3[a, b, w] else 0
        return share + m3 / (total + m3) * top / bottom

    out = []
    for d, text in rows:
        t = words(text)
        s = ["<s>", *t]
        p = [uni(t[0]), *(given(*g) for g in zip(s, s[1:], s[2:]))]
        out.append((d, len(t), sum(c[w] > 0 for w in t), n, sum(math.log10(uni(w)) for w in t), sum(map(math.log10, p))))
    # probabilities add up to one but for quantisation
    for a, b in list(c2)[:30]:
        if b is not None:
            assert abs(sum(given(a, b, w) for w in [*c, "never seen"]) - 1) < 1e-3
    return out


def corpus():
    rng = random.Random(8)
    v = [f"w{i}" if i % 5 else f"É{i}" for i in range(150)]
    rows = [(i, " ".join(rng.choices(v, weights=range(150, 0, -1), k=rng.randrange(60)))) for i in range(300)]
    rows += [(1000, None), (1001, ""), (1002, "\t A a b \x1c\n"), (1003, "new words " * 400), (None, "w1 w2"), (1004, "w1 w2"), (1004, "w1 w2")]
    return rows


def compare(got, expected):
    got = sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got), key=lambda r: str(r[:4]))
    expected = sorted(expected, key=lambda r: str(r[:4]))
    assert [g[:4] for g in got] == [e[:4] for e in expected]
    assert np.allclose([g[4:] for g in got], [e[4:] for e in expected], rtol=1e-6)


def test_scores_match_brute_force(spark, monkeypatch):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for partitions, work in ((1, 1 << 20), (4, 2000)):
        monkeypatch.setattr(lm, "WORK_BYTES", work)
        compare(lm.score_documents(docs.repartition(partitions)).collect(), brute(rows))
    held = {r.doc_id: r.held_out for r in lm.score_documents(docs).collect()}
    assert all(held[d] == (not learned(d)) for d, _ in rows)


def test_kept_model_scores_other_documents(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = lm.train(docs)
    others = [(k, " ".join(reversed((t or "x").split()))) for k, (_, t) in enumerate(rows)] + [(-1, rows[5][1])]
    got = lm.score(spark.createDataFrame(others, "doc_id long, text string"), model).withColumn("train_tokens", F.lit(model.tokens)).collect()
    compare(got, brute(others, [t for _, t in rows]))


def test_edges(spark):
    docs = spark.createDataFrame([(2, "a b"), (3, "c")], "doc_id long, text string")
    assert lm.score_documents(docs.limit(0)).count() == 0
    only_held = [d for d in range(100) if not learned(d)][:1]
    got = lm.score_documents(spark.createDataFrame([(only_held[0], "a b")], "doc_id long, text string")).collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got] == [(3, 0, 0, 0.0, 0.0)]


def test_very_large_counts_are_kept():
    context, sizes, successor = np.array([7, 9], np.uint64), np.array([2, 1]), np.array([1, 5, 2], np.uint64)
    for n in ([10**9, 3, 10**15], [1, 2, 3]):
        level = lm.GramsLevel(np.frombuffer(lm.grams_level(context, sizes, successor, np.array(n)), np.uint8))
        totals, shares = level.ask(np.array([7, 8, 9], np.uint64), np.array([2, 1, 2]), np.array([5, 5, 2, 2, 3], np.uint64))
        total = n[0] + n[1]
        assert np.allclose(lm._COUNTS[totals], [total, 0, n[2]], rtol=1e-3)
        assert np.allclose(lm._SHARES[shares], [*[n[1] / (total + lm.PRIORS[1])] * 2, 0, n[2] / (n[2] + lm.PRIORS[1]), 0], rtol=1e-3)


def test_many_different_words(spark):
    # three numbers of words don't fit in one key
    v = 1 << 20
    block = lm.Block(np.arange(v, dtype=np.uint64), np.random.default_rng(1).permutation(np.r_[np.arange(v), np.arange(50)]), np.zeros(v + 50, np.int64), np.array([v + 50]))
    grams = lm.grams_of(block, np.ones(1, bool), places=True)
    assert grams.count.sum() == v + 50 and (np.diff(grams.context.astype(object)) > 0).all()
    own = lm._mix(np.r_[np.uint64(lm._BEGIN), block.words[block.token[:-1]]], block.words[block.token])
    assert (grams.context[grams.owner] == own).all()
    assert (grams.successor[grams.place[:-1]] == block.words[block.token[1:]]).all()


def test_long_text(spark):
    text = " ".join(f"w{k % 977}" for k in range(400_000))
    got = lm.score_documents(spark.createDataFrame([(0, text), (1, "w1 w2")], "doc_id long, text string")).collect()
    assert {r.doc_id: r.n_tokens for r in got} == {0: 400_001, 1: 3}


def test_query_keeps_what_occurs_once(spark, tmp_path):
    rows = [r for r in corpus() if r[0] is not None and r[0] != 1004]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    compare(queries.op6_lm_scoring(spark, str(tmp_path)).collect(), brute(rows))
