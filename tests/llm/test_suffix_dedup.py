"""Suffix arrays and the removal of repeated strings against plain Python."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plateloom.llm import queries, suffix_dedup

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("seed", range(60))
def test_suffix_array(seed):
    rng = random.Random(seed)
    n, sigma = rng.choice([0, 1, 2, 3, 10, 80, 400]), rng.choice([1, 2, 3, 5, 50])
    s = [rng.randrange(sigma) for _ in range(n)]
    if seed % 3 == 0 and n:
        s = (s[: max(1, n // 7)] * 8)[:n]
        n = len(s)
    got = suffix_dedup.suffix_array(np.array(s, np.int64), sigma).tolist()
    assert got == sorted(range(n), key=lambda i: s[i:])
    assert suffix_dedup.rank_doubling(np.array(s, np.int64)).tolist() == got
    data = np.array(s, np.uint8)
    prefixes = suffix_dedup.permuted_common_prefixes(data, np.array(got, np.int64), 20)
    for a, b in zip(got, got[1:]):
        k = 0
        while k < 20 and a + k < n and b + k < n and s[a + k] == s[b + k]:
            k += 1
        assert prefixes[b] == k


def brute(rows):
    """(n_bytes, n_removed, n_spans, sha256) of each document."""
    first = {}
    for d, text in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        x = (text or "").encode()
        for p in range(len(x) - 49):
            first.setdefault(x[p : p + 50], d)
    out = []
    for d, text in rows:
        x = (text or "").encode()
        gone = bytearray(len(x))
        if d is not None:
            for p in range(len(x) - 49):
                if first[x[p : p + 50]] < d:
                    gone[p : p + 50] = b"\1" * 50
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        kept = bytes(b for b, g in zip(x, gone) if not g)
        out.append((d, len(x), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def digest(found):
    gone = F.aggregate("spans", F.lit(0).cast("bigint"), lambda acc, s: acc + s["stop"] - s["start"])
    rows = found.select("doc_id", "n_bytes", gone, F.size("spans"), F.sha2("kept", 256)).collect()
    return sorted((tuple(r) for r in rows), key=str)


def corpus():
    rng = random.Random(11)
    passage = [" ".join(rng.choice(["über", "alpha", "b", "gamma", "straße"]) for _ in range(rng.choice([9, 20, 60]))) for _ in range(8)]
    rows = []
    for d in range(120):
        parts = [" ".join(f"{rng.randrange(9999)}" for _ in range(rng.randrange(40))) for _ in range(rng.randrange(4))]
        parts += rng.sample(passage, rng.randrange(3))
        rng.shuffle(parts)
        rows.append((500 - d, "\n".join(parts)))
    rows += [(600, rows[5][1]), (601, rows[5][1]), (1, None), (2, ""), (3, "x" * 49), (4, "x" * 50), (5, "x" * 500), (6, "ab" * 300), (7, "ab" * 40), (8, "z" + "ab" * 30 + "\0" * 60), (9, "\0" * 70)]
    return rows


def test_matches_brute_force(spark, monkeypatch):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    expected = brute(rows)
    assert digest(suffix_dedup.dedup_bytes(docs.repartition(3))) == expected
    assert sum(r[2] for r in expected) > 1000
    monkeypatch.setattr(suffix_dedup, "WORK_BYTES", 700)
    monkeypatch.setattr(suffix_dedup, "PART_BYTES", 2000)
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", 1000)
    assert digest(suffix_dedup.dedup_bytes(docs.repartition(5))) == expected


def test_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert sorted((tuple(r) for r in queries.op7_suffix_dedup(spark, SF).collect()), key=str) == brute(rows)


def test_edges(spark):
    text = "one and the same text " * 5
    rows = [(None, text), (3, text), (3, text), (4, text), (5, text[:60])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("kept", F.lit(1))
    assert digest(suffix_dedup.dedup_bytes(docs)) == brute(rows)
    assert suffix_dedup.dedup_bytes(docs.limit(0)).count() == 0


def test_one_very_long_text(spark):
    rng = np.random.default_rng(0)
    long = "".join(chr(97 + x) for x in rng.integers(0, 26, 18_000_000))
    docs = spark.createDataFrame([(1, long[9_000_000:9_000_200]), (2, long)], "doc_id long, text string")
    got = {r.doc_id: [tuple(s) for s in r.spans] for r in suffix_dedup.dedup_bytes(docs).select("doc_id", "spans").collect()}
    assert got == {1: [], 2: [(9_000_000, 9_000_200)]}


def test_periodic_texts(spark):
    """Long runs of one byte, or of a few, are one run with equal pieces."""
    rows = [(1, " " * 300_000), (2, "x" + " " * 200_000 + "y"), (3, "=-" * 100_000), (4, "abc" * 70_000 + "d"), (5, "abc" * 9_000), (6, "-=" * 30)]
    got = {r.doc_id: (bytes(r.kept), r.n_bytes) for r in suffix_dedup.dedup_bytes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    text = dict(rows)
    assert got[1] == (text[1].encode(), 300_000) and got[3][0] == text[3].encode() and got[4][0] == text[4].encode()
    assert got[2] == (b"xy", 200_002) and got[5] == (b"", 27_000) and got[6] == (b"", 60)


def test_memory_of_periodic_texts():
    """64 MB of blanks need less than 1 GB."""
    import tracemalloc

    data = np.full(64 << 20, 32, np.uint8)
    texts = suffix_dedup.Texts(np.array([7]), data, np.array([len(data)]))
    known = np.unique(next(suffix_dedup._runs(texts)).anchor)
    tracemalloc.start()
    c = suffix_dedup._contexts(texts, known, 16)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(c.sizes) <= 20 and len(c.first) > 16_000 and peak < 1 << 30
