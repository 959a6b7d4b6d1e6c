"""The operators built from DataFrame functions alone, against plain Python."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from plateloom.llm import decontam, license_scan, line_dedup


# --- line dedup ---------------------------------------------------------------------------------------------------
def brute_lines(rows):
    chunks, first, split = {}, {}, {}
    for d, text in rows:
        lines = split[d] = (text or "").split("\n")
        n = len(lines)
        h = [int(hashlib.md5(x.encode()).hexdigest()[:7], 16) for x in lines]
        marked = [i > 0 and (h[i] + 8191 * h[i - 1]) % 1_000_003 % 4 != 0 for i in range(n)]
        own = set()
        for i in range(n):
            if i < n - 1:
                own.add((i, next((j for j in range(i + 1, min(i + 7, n - 1)) if marked[j]), min(i + 7, n - 1))))
            if i > 0:
                own.add((next((j - 1 for j in range(i, max(i - 7, 0), -1) if marked[j]), max(i - 7, 0)), i))
        chunks[d] = sorted(own)
    for d in sorted(split):
        for a, b in chunks[d]:
            first.setdefault(tuple(split[d][a : b + 1]), (d, a))
    out = {}
    for d, text in rows:
        gone = {i for a, b in chunks[d] if first[tuple(split[d][a : b + 1])] != (d, a) for i in range(a, b + 1)}
        out[d] = None if text is None else "\n".join(x for i, x in enumerate(split[d]) if i not in gone)
    return out


def line_corpus():
    rng = random.Random(1)
    block = [[f"line {b} {i}" for i in range(12)] for b in range(4)]
    rows = []
    for d in range(80):
        lines = [f"own {d} {i}" for i in range(rng.randrange(8))]
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(lines) + 1)
            lines[at:at] = rng.choice(block)
        rows.append((200 - d, "\n".join(lines)))
    return [*rows, (1, None), (2, ""), (3, "\n\n\n"), (4, "same\nsame\nsame\nsame\n" * 6), (5, "same\nsame\nsame\nsame\n" * 6)]


def test_line_dedup_matches_brute_force(spark):
    rows = line_corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = line_dedup.dedup_lines(docs).collect()
    assert {r.doc_id: r.text for r in out} == brute_lines(rows)
    assert sum(r._removed_lines for r in out) > 50
    assert all(r._n_lines == (0 if t is None else len(t.split("\n"))) for r in out for d, t in rows if d == r.doc_id)


def test_line_dedup_tells_lines_of_one_hash_apart(spark, monkeypatch):
    rows = line_corpus()
    monkeypatch.setattr(line_dedup, "_identity", lambda line: F.pmod(F.xxhash64(line), F.lit(5)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.text for r in line_dedup.dedup_lines(docs).collect()} == brute_lines(rows)


def test_line_dedup_finds_repeated_passages(spark):
    """Of passages of several lines that two documents share all lines go, but for a few of the shortest passages."""
    rng = random.Random(5)
    rows, shared = [], {}
    for k in range(400):
        n = 2 + k % 9
        passage = [f"passage {k} line {i} {rng.random()}" for i in range(n)]
        for copy in range(2):
            own = [f"own {k} {copy} {i} {rng.random()}" for i in range(8)]
            rows.append((2 * k + copy, "\n".join([*own[:4], *passage, *own[4:]])))
        shared[2 * k + 1] = n
    out = {r.doc_id: r._removed_lines for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(out[d] in (0, n) for d, n in shared.items()) and all(out[d] == 0 for d in out if d % 2 == 0)
    for n, least in ((2, 0.6), (3, 0.85), (4, 0.9), (6, 0.97), (10, 0.99)):
        found = [out[d] == n for d in shared if shared[d] == n]
        assert sum(found) >= least * len(found)
    # a very long text
    long = "\n".join(f"line {i % 70_000}" for i in range(100_000))
    got = line_dedup.dedup_lines(spark.createDataFrame([(1, long)], "doc_id long, text string")).first()
    assert got._removed_lines == 30_000 and got.text == "\n".join(long.split("\n")[:70_000])


def test_line_dedup_edges(spark):
    text = "a\nb\nc\nd\ne\nf"
    docs = spark.createDataFrame([(None, text, 1, "x"), (3, text, 11, "y"), (3, text, 11, "y"), (4, text, 11, "z")], "doc_id long, text string, n_chars long, _id string")
    out = line_dedup.without_repeats(docs)
    assert out.columns == docs.columns
    assert out.count() == 4
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0


# --- decontamination ------------------------------------------------------------------------------------------------
def words(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def brute_leaks(docs, items, threshold=0.8):
    from collections import Counter

    def shingles(ws, k):
        return Counter(tuple(ws[i : i + k]) for i in range(max(1, len(ws) - k + 1)))

    found = {}
    for d, text in docs:
        w = words(text)
        for i, item in items:
            iw = words(item)
            if not iw or not w:
                continue
            k, n = min(5, len(iw)), len(iw)
            ish = shingles(iw, k)
            for s in range(max(1, len(w) - n + 1)):
                wsh = shingles(w[s : s + n], k)
                sim = (ish & wsh).total() / (ish | wsh).total()
                if sim >= threshold:
                    found[d, i] = max(found.get((d, i), 0), sim)
    return found


def test_decontamination_matches_brute_force(spark):
    rng = random.Random(3)
    v = [f"w{i}" for i in range(400)]
    some = lambda n: [rng.choice(v) for _ in range(n)]
    items = [(i, " ".join(some(rng.choice([2, 4, 5, 12, 40, 60])))) for i in range(20)] + [(90, None), (91, " ."), (92, "ab ab ab ab ab ab ab")]
    docs = []
    for d in range(64, 180):
        w = some(rng.randrange(5, 200))
        if d % 3:
            inner = words(rng.choice(items[:20])[1])
            for _ in range(rng.choice([0, 0, 1, 2])):
                inner[rng.randrange(len(inner))] = rng.choice(v)
            at = rng.randrange(len(w))
            w[at:at] = inner[rng.choice([0, 0, 1]) :]
        docs.append((d, ", ".join(w).capitalize() + "."))
    docs += [(0, None), (1, ""), (2, "..."), (3, items[3][1].upper()), (4, "x ab ab ab ab ab ab ab y")]
    got = decontam.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    got = {(r.doc_id, r.item_id): r.similarity for r in got.collect()}
    expected = brute_leaks(docs, items)
    assert set(got) == set(expected) and len(got) > 15
    assert all(abs(got[k] - expected[k]) < 0.1 for k in got)


def first_best_windows(docs, items, threshold=0.8):
    """Similarity and start of the most similar, then first, of all windows of each document and item."""
    from collections import Counter

    found = {}
    for d, text in docs:
        w = words(text)
        for i, item in items:
            iw = words(item)
            k, n = min(5, len(iw)), len(iw)
            shingles = lambda ws: Counter(tuple(ws[x : x + k]) for x in range(max(1, len(ws) - k + 1)))
            ish = shingles(iw)
            for s in range(max(1, len(w) - n + 1)):
                wsh = shingles(w[s : s + n])
                sim = (ish & wsh).total() / (ish | wsh).total()
                if sim >= max(threshold, found.get((d, i), (0, 0))[0] + 1e-12):
                    found[d, i] = (sim, s)
    return found


def test_decontamination_finds_moved_and_inserted_words(spark):
    rng = random.Random(8)
    fresh = iter(range(10**6))
    some = lambda n: [f"x{next(fresh)}" for _ in range(n)]
    items = [(i, " ".join(some(n))) for i, n in enumerate([59, 59, 100, 7, 30, 3])]
    a, b, c, *rest = (words(x) for _, x in items)
    changed = [
        a[30:] + a[:30],  # halves swapped
        some(1) + b[1:29] + some(2) + b[29:58] + some(1),
        some(3) + c[3:50] + some(6) + c[50:97] + some(3),
        some(1) + a[1:58] + some(1),
        a[25:] + a[:25] + some(4) + a[30:] + a[:30],
        *rest,
    ]
    docs = []
    for d, w in enumerate(changed * 3):
        docs.append((d, " ".join(some(rng.choice([0, 5, 80])) + w + some(rng.choice([0, 5, 80])))))
    docs += [(90, " ".join(a[2:])), (91, " ".join(a[9:])), (92, " ".join(b[:57]))]
    for d in range(100, 160):  # an item with words cut, put in and reordered
        w = words(rng.choice(items)[1])
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(w))
            w[at:at] = some(rng.randrange(4))
        turn = rng.randrange(len(w)) if rng.random() < 0.4 else 0
        docs.append((d, " ".join(some(rng.randrange(9)) + w[turn:] + w[:turn] + some(rng.randrange(9)))))
    got = decontam.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id): (r.similarity, r.start_word) for r in got.collect()} == first_best_windows(docs, items)


def test_decontamination_in_blocks_and_edges(spark, monkeypatch):
    docs = spark.createDataFrame([(None, "one two three four five six seven", 1), (2, "one two three four five six seven", 2), (2, "one two three four five six seven", 2), (3, "other", 3)], "doc_id long, text string, n int")
    items = spark.createDataFrame([(1, "one two three four five six seven"), (2, "three four five six seven"), (None, "other")], "item_id long, text string")
    monkeypatch.setattr(decontam, "BLOCK_SHINGLES", 2)
    got = {(r.doc_id, r.item_id) for r in decontam.contamination(docs, items).collect()}
    assert got == {(None, 1), (None, 2), (2, 1), (2, 2), (3, None)}
    kept = decontam.decontaminate(docs, items)
    assert kept.columns == docs.columns and [r.doc_id for r in kept.collect()] == [None]
    assert decontam.contamination(docs.limit(0), items).count() == 0
    assert decontam.contamination(docs, items.limit(0)).count() == 0


# --- license scans --------------------------------------------------------------------------------------------------
def brute_scan(text):
    t = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)
    base = [(i, label) for phrase, label in license_scan.BASE for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
    normal = " ".join(w)
    found = []
    for p, label, pattern, _, _, weight in license_scan.rules():  # without the prefilter
        for m in re.finditer(pattern, normal):
            a = normal[: m.start()].count(" ")
            found.append((a, -(a + m.group().count(" ") + 1), p, label, weight))
    kept, reach = [], 0
    for d in sorted(found):
        if -d[1] > reach:
            kept.append(d)
            reach = -d[1]
    final = [d for i, d in enumerate(kept) if not (i and -kept[i - 1][1] > d[0] and kept[i - 1][2] <= d[2]) and not (i + 1 < len(kept) and -d[1] > kept[i + 1][0] and kept[i + 1][2] < d[2])]
    places = [i for i, _ in base]
    bl = sorted({x for _, x in base})
    return (len(w), len(base), min(places, default=None), max(places, default=None), ",".join(bl), ",".join(sorted({*bl, *(d[3] for d in final)})), max((d[4] for d in final), default=0.5 if base else 0.0))


LICENSED = [
    None,
    "",
    " ... ",
    "Released under the MIT License.",
    "This work is licensed under the GNU General Public License, version 3. All rights reserved.",
    "Licensed under the Apache License, Version 2.0. CC-BY 4.0; cc by",
    "SPDX-License-Identifier: LGPL-2.1\nRedistribution and use in source and binary forms",
    "émit limit été CC BY cc\tby, ALL RIGHTS RESERVED all rights reserved",
    "Provided as is without warranty of any kind; Copyright (c) 2019 2020 X. Public domain: in the public domain",
    "under the terms of the bsd 3-clause licence apache 2 license mozilla public license 2.0",
    "cc by cc by " * 300,
]


def test_license_scan_matches_brute_force(spark):
    docs = spark.createDataFrame(list(enumerate(LICENSED)) + [(3, LICENSED[3])], "doc_id long, text string")
    for r in license_scan.scan(docs).collect():
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) == brute_scan(LICENSED[r.doc_id]), LICENSED[r.doc_id]
    assert len(license_scan.rules()) > 200
    found = {r.doc_id: r.labels for r in license_scan.scan(docs).collect()}
    assert found[3] == "mit" and "gpl-3.0" in found[4] and "apache-2.0" in found[5]
    assert license_scan.scan(docs.limit(0)).count() == 0
