"""Suffix deduplication with many parts and shards, as large inputs have."""

import random

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("zstandard")
from plateloom.llm import suffix_dedup


def texts(n: int) -> list[tuple[int, str]]:
    rng = random.Random(4)
    passages = ["".join(rng.choice("abcdefgh ") for _ in range(rng.choice([49, 50, 51, 90, 400]))) for _ in range(30)]
    return [(d, " ".join(rng.choice(passages) if rng.random() < 0.5 else "".join(rng.choice("abcdefgh ") for _ in range(80)) for _ in range(rng.randrange(6)))) for d in range(n)]


def test_anchors_make_a_row_for_each_shard():
    """Not one for each part and shard, whose number grows with the square of the input."""
    rows = texts(400)
    batch = pa.RecordBatch.from_arrays([pa.array([d for d, _ in rows], pa.int64()), pa.array([t for _, t in rows])], names=["doc_id", "text"])
    (out,) = suffix_dedup._anchors(300, 5)(iter([batch]))
    assert out.num_rows == 5
    found = suffix_dedup._repeated(pa.Table.from_batches([out]))
    # the anchors of each part that several documents have
    where: dict[int, set] = {}
    data = np.frombuffer("".join(t for _, t in rows).encode(), np.uint8)
    r = suffix_dedup.anchor_runs(data, np.cumsum([len(t) for _, t in rows]))
    for a, d in zip(r.anchor.tolist(), r.doc.tolist()):
        where.setdefault(a, set()).add(d)
    own = suffix_dedup._part_of(np.arange(400), 300)
    expected: dict[int, set] = {}
    for a, docs in where.items():
        for d in docs if len(docs) > 1 else ():
            expected.setdefault(int(own[d]), set()).add(a)
    got = {p: suffix_dedup._unpacked(x.as_py())[0].tolist() for p, x in zip(found.column("part").to_pylist(), found.column("payload"))}
    assert {p: set(a) for p, a in got.items()} == expected and all(len(a) == len(set(a)) for a in got.values())


def test_many_parts_and_small_arrays(spark, monkeypatch):
    rows = texts(300)
    first: dict[bytes, int] = {}
    for d, t in rows:
        for i in range(len(t) - 49):
            first.setdefault(t[i : i + 50].encode(), d)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for name, size in (("PART_BYTES", 1000), ("SHARD_BYTES", 9000), ("ANCHOR_BYTES", 20000), ("WORK_BYTES", 500)):
        monkeypatch.setattr(suffix_dedup, name, size)
    got = {r.doc_id: bytes(r.kept) for r in suffix_dedup.dedup_bytes(docs).collect()}
    for d, t in rows:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - 49):
            if first[t[i : i + 50].encode()] < d:
                gone[i : i + 50] = True
        assert got[d] == bytes(b for b, g in zip(t.encode(), gone) if not g)


def test_arrays_of_whole_anchors(monkeypatch):
    """A shard in many arrays has the answers of one."""
    rows = texts(300)
    shard = []
    for d, t in rows:
        own = np.frombuffer(t.encode(), np.uint8)
        known = np.unique(suffix_dedup.anchor_runs(own, np.array([len(own)])).anchor)
        c = suffix_dedup._contexts(suffix_dedup.Texts(np.array([d]), own, np.array([len(own)])), known, 1)
        shard.append(suffix_dedup._packed([c.data, c.sizes.astype(np.uint32), c.least, c.anchor]))
    table = pa.table({"shard": pa.array([0] * len(shard), pa.int32()), "part": pa.array(range(len(shard)), pa.int32()), "payload": pa.array(shard, pa.binary())})
    answers = []
    for size in (1 << 30, 300):
        monkeypatch.setattr(suffix_dedup, "ARRAY_BYTES", size)
        answers.append([suffix_dedup._unpacked(p.as_py())[1].tolist() for p in suffix_dedup._compare(table).column("payload")])
    assert answers[0] == answers[1] and any(any(a) for a in answers[0])
