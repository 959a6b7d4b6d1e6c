"""Language ID, packing, top-k search and web archives."""

import random
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from plateloom.llm import language_id, packing, topk, warc

SF = "/root/testdata/sf0.01"


# --- language ID ----------------------------------------------------------------------------------------------------
def brute_viterbi(scores, switch):
    """The best score of all labellings, tried one by one."""
    from itertools import product

    n, k = scores.shape
    return max(sum(scores[t, s] for t, s in enumerate(p)) - switch * sum(a != b for a, b in zip(p, p[1:])) for p in product(range(k), repeat=n))


def test_viterbi_finds_the_best_labelling():
    rng = np.random.default_rng(0)
    for _ in range(30):
        sizes = rng.integers(0, 6, 5)
        offsets = np.r_[0, np.cumsum(sizes)]
        scores = rng.normal(size=(7, 3)).astype(np.float32) * 3
        index = rng.integers(0, 7, offsets[-1])
        labels = language_id.viterbi(scores, index, offsets, 1.5)
        for a, b in zip(offsets, offsets[1:]):
            if a < b:
                own, path = scores[index[a:b]], labels[a:b]
                got = own[np.arange(b - a), path].sum() - 1.5 * (path[1:] != path[:-1]).sum()
                assert abs(got - brute_viterbi(own, 1.5)) < 1e-4


def test_language_id_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = language_id.identify(docs.select("doc_id", "text", "lang")).withColumn("held", language_id.held_out(F.col("doc_id"))).collect()
    own = [r for r in rows if r.held]
    assert len(own) > 100
    assert sum(r._lang == r.lang for r in own) / len(own) > 0.97
    assert all(0 <= r._score <= 1 for r in rows)


def test_language_id_spans_and_edges(spark):
    rng = random.Random(2)
    words = {"en": ["the", "with", "house", "which", "and"], "de": ["der", "nicht", "über", "straße", "und"], "ru": ["это", "дом", "который", "есть", "не"]}
    text = lambda lang, n: " ".join(rng.choice(words[lang]) for _ in range(n))
    rows = [(i, text(lang, 40), lang, "x") for i, lang in enumerate(["en", "de", "ru"] * 30)]
    mixed = f"{text('en', 20)}, {text('ru', 20)}; {text('de', 20)}."
    rows += [(900, None, "en", "x"), (901, "", "en", "x"), (902, "12 -- 3", None, "x"), (903, mixed, None, "x"), (None, text("de", 9), "en", "x"), (904, "ギリシャ", None, "x"), (904, "ギリシャ", None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, _lang string")
    out = language_id.identify(docs)
    got = {r.doc_id: r for r in out.collect()}
    assert all(got[i]._lang == rows[i][2] for i in range(90))
    assert [got[i]._lang for i in (900, 901, 902)] == ["und"] * 3 and got[900]._spans == []
    assert [s.lang for s in got[903]._spans] == ["en", "ru", "de"]
    assert [(s.first, s.stop) for s in got[903]._spans] == [(0, 20), (20, 40), (40, 60)]
    assert out.count() == len(rows) and got[None]._lang == "de"
    kept = language_id.keep_identified(docs)
    assert kept.columns == docs.columns and kept.filter("doc_id between 900 and 902").count() == 0
    assert language_id.identify(docs.limit(0)).count() == 0
    unlabelled = language_id.identify(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r._lang for r in unlabelled.collect()} == {"und"}


def test_texts_of_three_languages_are_kept(spark):
    words = {"en": "the with house which and", "de": "der nicht über straße und", "ru": "это дом который есть не"}
    rows = [(i, " ".join([words[lang]] * 8), lang) for i, lang in enumerate(["en", "de", "ru"] * 30)]
    rows += [(900, f"{' '.join([words['en']] * 9)}. {' '.join([words['ru']] * 6)}. {' '.join([words['de']] * 5)}", None), (901, "12 -- 3", None), (902, None, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    top = language_id.identify(docs).filter("doc_id = 900").first()
    assert [s.lang for s in top._spans] == ["en", "ru", "de"] and top._score == 0.45
    kept = {r.doc_id for r in corpus_pipeline.identify_language(spark, docs, SF).collect()}
    assert kept == {*range(90), 900}


def test_very_long_text(spark):
    docs = spark.createDataFrame([(1, "the house and " * 60_000, "en"), (4, "der und nicht " * 10, "de")], "doc_id long, text string, lang string")
    assert {r.doc_id: r._lang for r in language_id.identify(docs).collect()} == {1: "en", 4: "de"}


# --- packing --------------------------------------------------------------------------------------------------------
def check_packing(rows, tokens, lengths):
    bins, own = {}, {}
    for r in rows:
        bins.setdefault((r.bin_id, r.bin_length), []).append((r.bin_offset, r.n_tokens))
        own.setdefault(r.doc_id, []).append((r.start, r.n_tokens))
    assert len({b for b, _ in bins}) == len(bins)
    for (_, length), parts in bins.items():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert length == min(x for x in lengths if x >= at)
    for d, n in tokens.items():
        at = 0
        for start, size in sorted(own.get(d, [])):
            assert start == at
            at += size
        assert at == n
    used = sum(r.n_tokens for r in rows)
    return used / sum(length for _, length in bins)


def test_packing_covers_every_token(spark):
    rng = random.Random(4)
    rows = [(i, "w " * rng.choice([1, 5, 40, 255, 256, 700, 5000])) for i in range(900)] + [(2000, None), (2001, ""), (2002, " x ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = packing.pack_documents(docs).collect()
    fill = check_packing(got, {d: len((t or "").split()) + 1 for d, t in rows}, packing.LENGTHS)
    assert fill > 0.95
    assert packing.pack_documents(docs.limit(0)).count() == 0
    twice = packing.pack_documents(spark.createDataFrame([(None, "a"), (1, "a"), (1, "a")], "doc_id long, text string")).collect()
    assert len(twice) == 3 and len({(r.bin_id, r.bin_offset) for r in twice}) == 3
    clash = docs.selectExpr("doc_id", "text", "1 as n", "2 as piece", "3 as shard").limit(5)
    assert packing.pack_documents(clash, tokens=F.col("n")).count() == 5


def test_packing_against_the_best_possible():
    """On small inputs the total length is near that of the best partition, found by trying all."""

    def partitions(xs):
        if not xs:
            yield []
            return
        for rest in partitions(xs[1:]):
            yield [[xs[0]], *rest]
            for i, part in enumerate(rest):
                yield [*rest[:i], [xs[0], *part], *rest[i + 1 :]]

    rng = np.random.default_rng(1)
    lengths = (8, 16, 32)
    for _ in range(25):
        sizes = rng.integers(1, 25, 7)
        fits = lambda p: min((x for x in lengths if x >= sum(p)), default=None)
        best = min(sum(map(fits, p)) for p in partitions(sizes.tolist()) if all(fits(x) for x in p))
        held, offset, shrunk = packing.pack(sizes, lengths)
        assert all(sizes[held == b].sum() <= shrunk[b] for b in range(len(shrunk)))
        assert shrunk.sum() <= 1.5 * best


# --- top-k ----------------------------------------------------------------------------------------------------------
def brute_top_k(rows, query_ids, k):
    import math

    v = {}
    listed = []
    for i, x in rows:
        if i is not None and x is not None and all(c is not None and math.isfinite(c) for c in x):
            listed.append((i, [math.floor(1024 * c) for c in x]))
            v.setdefault(i, listed[-1][1])
    out = set()
    for q in query_ids:
        if q in v:
            scored = sorted((-sum(a * b for a, b in zip(v[q], x)), i) for i, x in listed if i != q and len(x) == len(v[q]))
            out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])}
    return out


@pytest.mark.parametrize("scale", [1.0, 1e5])
def test_top_k_matches_brute_force(spark, scale, monkeypatch):
    monkeypatch.setattr(topk, "LEAF_ROWS", 8)
    monkeypatch.setattr(topk, "SHARD_ROWS", 64)
    rng = random.Random(6)
    rows = [(i, [rng.choice([-0.5, 0.25, rng.gauss(0, 1)]) * scale for _ in range(6)]) for i in range(500)]
    rows += [(i, rows[7][1]) for i in range(500, 640)]  # a very common vector
    rows += [(700, None), (800, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (900, [float("nan")] * 6), (1000, [float("inf")] * 6), (1100, [1.0, 2.0]), (1200, [2.0, 2.0]), (None, [1.0] * 6), (1300, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = topk.top_k_of_table(df, "vec_id", "embedding", F.col("vec_id") % 20 == 0, 10)
    assert {tuple(r) for r in got.collect()} == brute_top_k(rows, range(0, 2000, 20), 10)
    monkeypatch.setattr(topk, "QUERY_ROWS", 7)
    again = topk.top_k_of_table(df, "vec_id", "embedding", F.col("vec_id") % 20 == 0, 10)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, got.collect()))
    assert topk.top_k_of_table(df.limit(0), "vec_id", "embedding", F.col("vec_id") % 20 == 0).count() == 0


# --- web archives ---------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("version", [1, 2])
def test_arc_files_become_warc(version):
    bodies = [("http://a.example/x y\n", b"hi\n\nthere", "text/html"), ("dns:a.example", "é\r\n\r\n".encode(), "text/dns"), ("https://b.example/", b"", "")]
    arc = warc.arc_version_block(version) + b"".join(warc.arc_record(version, p, u, "2001020304", k) for u, p, k in bodies)
    records = list(warc.read_warc(warc.arc_to_warc(arc)))
    assert [h["warc-type"] for h, _ in records] == ["warcinfo", "response", "resource", "response"]
    assert [p for _, p in records[1:]] == [p for _, p, _ in bodies]
    assert records[1][0]["warc-date"] == "2001-02-03T04:00:00Z"
    assert len({h["warc-record-id"] for h, _ in records}) == 4
    assert records[1][0]["warc-target-uri"] == "http://a.example/x%20y%0A"
    assert datetime.fromisoformat(records[0][0]["warc-date"].rstrip("Z")).year == 1996
    assert warc.arc_to_warc(arc) == warc.arc_to_warc(arc)


def test_broken_archives_are_refused():
    good = warc.arc_version_block(1) + warc.arc_record(1, b"12345", "http://a/")
    for bad in (good[:-2], good.replace(b"filedesc", b"filedisc"), b"x", good.replace(b" 5\n", b" -5\n"), good.replace(b"0.0.0.0 19960923142103 text/html", b"text/html")):
        with pytest.raises(ValueError):
            list(warc.read_arc(bad))
    with pytest.raises(ValueError):
        list(warc.read_warc(warc.arc_to_warc(good)[:-1]))
    # an old crawler's URL with a blank
    assert list(warc.read_arc(warc.arc_version_block(1) + b"\nhttp://a/b c 0.0.0.0 1996 text/html 2\nok"))[1][0]["url"] == "http://a/b c"


def test_pages_round_trip(spark):
    import hashlib

    big = "é<p>" * 400
    rows = [(1, "http://a/", big), (2, "http://b/ ?q=ü", big), (3, None, None), (4, "x", ""), (5, "http://c/", "small"), (6, "http://c/", "small"), (7, "http://d/", "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n" * 40), (9, "http://a/", big), (None, "http://a/", big), (9, "http://a/", big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = warc.round_trip(pages).collect()
    assert len(got) == len(rows)
    for r in got:
        html = next(h for p, _, h in rows if p == r.page_id) or ""
        assert (r.payload_bytes, r.payload_digest) == (len(html.encode()), hashlib.sha1(html.encode()).hexdigest())
        expected = ("revisit", 9) if r.page_id in (1, 2) else ("response", None)
        assert (r.record_type, r.refers_to) == expected
    assert warc.round_trip(pages.limit(0)).count() == 0
