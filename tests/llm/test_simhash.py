"""SimHash classes against a brute-force comparison of all pairs."""

import random

import xxhash

from plateloom.llm import simhash


def brute_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hs = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(rows, radius=4):
    fps = [brute_fingerprint(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return {d: (fps[i], least[find(i)]) for i, (d, _) in enumerate(rows)}


def corpus(n=240):
    rng = random.Random(5)
    vocabulary = [f"w{i}É" if i % 9 == 0 else f"w{i}" for i in range(80)]
    rows = []
    for i in range(n):
        if rows and rng.random() < 0.5:
            words = (rng.choice(rows)[1] or "x").split(" ")
            for _ in range(rng.choice([0, 0, 1, 2])):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            text = " ".join(words)
        else:
            text = " ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 3, 4, 8, 60, 300])))
        rows.append((1000 - i, text.upper() if rng.random() < 0.1 else text))
    rows += [(5000, None), (5001, ""), (5002, " \n\t"), (5003, "one"), (5004, " a b")]
    return rows


def test_matches_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.fp & (2**64 - 1), r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert got == brute_components(rows)
    assert len({c for _, c in got.values()}) < len(rows)


def test_small_tiles_give_the_same(spark, monkeypatch):
    rows = corpus(150)
    monkeypatch.setattr(simhash, "TILE_ROWS", (16, 32))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert got == {d: c for d, (_, c) in brute_components(rows).items()}


def test_edges(spark):
    docs = spark.createDataFrame([(None, "a b c d e"), (7, "a b c d e"), (7, "a b c d e"), (9, "a b c d e")], "doc_id long, text string")
    got = sorted(simhash.near_duplicates(docs).collect(), key=str)
    assert sorted((r.doc_id or 0, r.component_id) for r in got if r.doc_id) == [(7, 7), (7, 7), (9, 7)]
    assert [r.component_id for r in got if r.doc_id is None] == [None]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    clash = docs.selectExpr("doc_id", "text", "1 as fp", "2 as component_id", "3 as _gone")
    kept = simhash.keep_one_of_each(clash)
    assert kept.columns == clash.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["7", "7", "None"]


def brute_similar(rows, k=5, similarity=0.8):
    """Classes of texts by all pairs of sets of shingles."""
    def shingles(text):
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
        n = min(k, len(w))
        return {b" ".join(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()

    sets, where = [shingles(t) for _, t in rows], {}
    for i, x in enumerate(sets):
        for s in x or {b""}:
            where.setdefault(s, []).append(i)
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, x in enumerate(sets):
        common = {}
        for s in x or {b""}:
            for j in where[s]:
                if j < i:
                    common[j] = common.get(j, 0) + 1
        for j, n in common.items():
            if not x or n >= similarity * (len(x) + len(sets[j]) - n) - 1e-9:
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return {d: least[find(i)] for i, (d, _) in enumerate(rows)}


def test_similar_documents_match_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    expected = brute_similar(rows)
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(docs).collect()}
    assert got == expected
    assert len({d for d, c in expected.items() if d != c}) > 50


def test_similar_documents_of_a_large_group(spark):
    """Variants of one text, of which neighbours are similar and distant ones needn't be, and texts just below the limit."""
    rng = random.Random(9)
    base = [f"word{rng.randrange(5000)}" for _ in range(150)]
    rows, now = [], list(base)
    for d in range(300):
        rows.append((d, " ".join(now)))
        now[rng.randrange(150)] = f"new{d}"
    rows += [(1000 + d, " ".join(f"w{rng.randrange(9000)}" for _ in range(60))) for d in range(200)] + [(5000, None), (5001, " "), (None, "a b")]
    got = simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    expected = brute_similar([r for r in rows if r[0] is not None])
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == expected
    assert [r.component_id for r in got if r.doc_id is None] == [None]


def test_blocks_cut_into_parts_give_the_same(spark, monkeypatch):
    """Texts at either side of the limit, all loosely similar, compared in parts of a few rows."""
    rng = random.Random(4)
    base = [f"word{rng.randrange(5000)}" for _ in range(120)]
    rows = []
    for d in range(90):
        words = list(base)
        for at in rng.sample(range(120), rng.choice([1, 3, 5, 8])):
            words[at] = f"new{d}x{at}"
        rows.append((d, " ".join(words)))
    rows.append((0, " ".join(rows[1][1].split()[:60])))
    monkeypatch.setattr(simhash, "BLOCK_ROWS", 8)
    monkeypatch.setattr(simhash, "CLOSE", 0)
    docs = spark.createDataFrame(rows[:-1], "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(docs).collect()}
    assert got == brute_similar(rows[:-1])
    shared = spark.createDataFrame([rows[-1], rows[0], rows[0]], "doc_id long, text string")
    assert [tuple(r) for r in simhash.similar_documents(shared).collect()] == [(0, 0)] * 3
