"""SimHash near-duplicate classes: fingerprints, tiled exact comparison, components."""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plateloom.llm.common import connected_components, stage
from plateloom.llm.memory import release, released

SHINGLE_WORDS = 4
RADIUS = 4
HASH_SEED = 42
#: Fingerprints in a tile: about this many tiles, within these bounds.
TILES = 24
TILE_ROWS = (2048, 1 << 20)
LEAF_ROWS = 256


def fingerprint(text: bytes | None, words_in_shingle: int = SHINGLE_WORDS) -> int:
    """The 64-bit SimHash of UTF-8 ``text``: a bit is set if over half of the shingle hashes have it set.

    A-Z are lower-cased and words end at ASCII white space; shingles count as often as they occur. A text with
    fewer words than a shingle is one shingle. Null, empty and blank texts get zero.
    """
    words = (text or b"").lower().split()
    if not words:
        return 0
    k = min(words_in_shingle, len(words))
    joined = b" ".join(words)
    ends = [at - 1 for at in accumulate(len(w) + 1 for w in words)]
    starts = [0, *(at + 1 for at in ends)]
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    n = len(words) - k + 1
    for at in range(0, n, 1 << 16):
        to = min(n, at + (1 << 16))
        hashes = np.fromiter((digest(joined[a:b], HASH_SEED) for a, b in zip(starts[at:to], ends[at + k - 1 : to + k - 1])), np.uint64, to - at)
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words_in_shingle: int = SHINGLE_WORDS) -> DataFrame:
    """``(doc_id long, fp long)`` for each row of ``docs``, over whole texts."""

    def run(batches):
        for batch in released(batches):
            texts = batch.column("text").cast(pa.binary())
            found = np.fromiter((fingerprint(t.as_py(), words_in_shingle) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


def _leaves(points: np.ndarray) -> list[np.ndarray]:
    """Indices of ``points`` in groups of at most LEAF_ROWS, split at the median of the widest dimension."""
    out, todo = [], [np.arange(len(points))]
    while todo:
        at = todo.pop()
        if len(at) <= LEAF_ROWS:
            out.append(at)
            continue
        own = points[at]
        dim = int(np.argmax(own.max(0).astype(int) - own.min(0)))
        order = np.argpartition(own[:, dim], len(at) // 2)
        todo += [at[order[: len(at) // 2]], at[order[len(at) // 2 :]]]
    return out


class _Forest:
    """Union-find over numpy labels; links come in bulk and most of them are already known."""

    def __init__(self, n: int) -> None:
        self.label = np.arange(n)
        self.used: list[tuple[int, int]] = []  # the links that joined two trees

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        la, lb = self.label[a], self.label[b]
        new = np.flatnonzero(la != lb)
        if not len(new):
            return
        pairs, at = np.unique(np.stack([np.minimum(la[new], lb[new]), np.maximum(la[new], lb[new])], 1), axis=0, return_index=True)
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            while (y := parent.get(x, x)) != x:
                parent[x] = parent.get(y, y)
                x = y
            return x

        for (x, y), k in zip(pairs.tolist(), new[at].tolist()):
            p, q = find(x), find(y)
            if p != q:
                parent[max(p, q)] = min(p, q)
                self.used.append((int(a[k]), int(b[k])))
        to = np.arange(len(self.label))
        to[list(parent)] = [find(x) for x in parent]
        self.label = to[self.label]


def _near(fps: np.ndarray, n_first: int, radius: int):
    """Pairs of rows, one of either tile, whose fingerprints differ in at most ``radius`` bits, in bulk."""
    pops = np.bitwise_count(fps.view(np.uint16).reshape(-1, 4)).astype(np.int16)
    alone = n_first == len(fps)
    left = _leaves(pops[:n_first])
    right = left if alone else [x + n_first for x in _leaves(pops[n_first:])]
    low, high = (np.array([f(pops[x], axis=0) for x in right]) for f in (np.min, np.max))
    for k, a in enumerate(left):
        gap = np.maximum(0, np.maximum(low - pops[a].max(0), pops[a].min(0) - high)).sum(1)
        near = np.flatnonzero(gap <= radius)
        near = near[near >= k] if alone else near
        if not len(near):
            continue
        others = np.concatenate([right[x] for x in near])
        for at in range(0, len(others), 4096):
            b = others[at : at + 4096]
            i, j = np.nonzero(np.bitwise_count(fps[a][:, None] ^ fps[b][None, :]) <= radius)
            yield a[i], b[j]


def _candidates(fps: np.ndarray, more: np.ndarray, rest: np.ndarray, size: np.ndarray, n_first: int, radius: int, share: float, forest: _Forest):
    """Pairs of rows of two tiles (or one) that may be similar and are in different trees of ``forest``, in bulk, with the bits they
    differ in.

    The first two words of two fingerprints, ``fps`` and ``more``, have to differ in at most ``radius`` bits each, and all of
    them in REACH at most, unless one of the texts has under FEW shingles. The smaller of two texts has at least ``share`` of
    the different shingles (``size``) of the larger, or they can't be similar.
    """
    for i, j in _near(fps, n_first, radius):
        enough = np.minimum(size[i], size[j]) >= share * np.maximum(size[i], size[j]) - 1e-9
        other = np.bitwise_count(more[i] ^ more[j])
        some = np.flatnonzero((other <= radius) & enough & (forest.label[i] != forest.label[j]))
        d = other[some].astype(np.int64) + np.bitwise_count(fps[i[some]] ^ fps[j[some]])
        for at in range(0, len(some), 1 << 16):
            part = some[at : at + (1 << 16)]
            d[at : at + (1 << 16)] += np.bitwise_count(rest[i[part]] ^ rest[j[part]]).sum(1, dtype=np.int64)
        near = (d <= REACH) | (np.minimum(size[i[some]], size[j[some]]) < FEW)
        if near.any():
            yield i[some[near]], j[some[near]], d[near]


def candidate_links(fps: np.ndarray, more: np.ndarray, rest: np.ndarray, size: np.ndarray, n_first: int, radius: int, close: int, share: float) -> list[tuple[int, int, int]]:
    """Two spanning forests of pairs of rows: of those that differ in ``close`` bits at most (third value 0), and of all
    ``_candidates`` (1). Together they are fewer than two for each row, however many pairs there are.
    """
    tight, loose = _Forest(len(fps)), _Forest(len(fps))
    for i, j, d in _candidates(fps, more, rest, size, n_first, radius, share, tight):
        near = d <= close
        tight.link(i[near], j[near])
        loose.link(i, j)
    return [*((i, j, 0) for i, j in tight.used), *((i, j, 1) for i, j in loose.used)]


def similar_links(fps: np.ndarray, more: np.ndarray, rest: np.ndarray, sets: list[np.ndarray], n_first: int, radius: int, similarity: float, label: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the ``_candidates`` whose ``sets`` of shingles (sorted hashes) have ``similarity``.

    Rows of one label are known to be linked. The closest pairs of each bulk are compared first.
    """
    forest = _Forest(len(fps))
    forest.label = np.unique(label, return_inverse=True)[1]
    size = np.array([len(x) for x in sets], np.int64)
    for i, j, d in _candidates(fps, more, rest, size, n_first, radius, similarity, forest):
        order = np.argsort(d, kind="stable")
        for a, b in zip(i[order].tolist(), j[order].tolist()):
            if forest.label[a] == forest.label[b]:
                continue
            x, y = (sets[a], sets[b]) if len(sets[a]) > len(sets[b]) else (sets[b], sets[a])
            common = int((x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y).sum()) if len(y) else 0
            if common >= similarity * (len(x) + len(y) - common) - 1e-9:
                forest.link(np.array([a]), np.array([b]))
    return forest.used


def tile_links(fps: np.ndarray, reps: np.ndarray, n_first: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest, as edges ``(rep, least rep)``, of the links between two tiles.

    The first ``n_first`` rows are one tile, the rest the other; with no rest, the tile is compared with itself.
    Each tile is cut into small boxes by the bit counts of its fingerprints' four 16-bit words. The Hamming distance of
    two fingerprints is at least the summed differences of these counts, so pairs of boxes further apart than
    ``radius`` are skipped; all other pairs are compared bit by bit.
    """
    forest = _Forest(len(fps))
    for i, j in _near(fps, n_first, radius):
        forest.link(i, j)
    least = np.full(len(fps), np.iinfo(np.int64).max)
    np.minimum.at(least, forest.label, reps)
    least = least[forest.label]
    linked = reps != least
    return reps[linked], least[linked]


def links(distinct: DataFrame, radius: int = RADIUS, close: int | None = None, share: float = 0.0) -> DataFrame:
    """Edges ``(u, v)`` that connect all of ``distinct(fp, rep)`` whose fingerprints differ in at most ``radius`` bits.

    With ``close`` they are the ``candidate_links`` ``(u, v, d)`` of rows that also have ``more`` and ``rest``, the other words of the
    fingerprint, and their ``size``.

    Tiles hold fingerprints of neighbouring bit counts. Each pair of tiles that can hold a link is a group of its own
    of bounded size, and gives a spanning forest of its links, never all of its pairs.
    """
    counts = sorted((r[0], r[1]) for r in distinct.groupBy(F.bit_count("fp").alias("pc")).count().collect())
    total = sum(n for _, n in counts)
    rows = min(max(-(-total // TILES), TILE_ROWS[0]), TILE_ROWS[1])
    first, salts, low, high = {}, {}, [], []
    room = 0
    for pc, n in counts:
        if n <= room:  # joins the tile of the class before it
            first[pc], salts[pc], room = len(low) - 1, 1, room - n
            high[-1] = pc
            continue
        first[pc], salts[pc] = len(low), -(-n // rows)
        low += [pc] * salts[pc]
        high += [pc] * salts[pc]
        room = rows - n if salts[pc] == 1 else 0
    tiles = len(low)
    if not tiles:
        return distinct.sparkSession.createDataFrame([], "u long, v long" if close is None else "u long, v long, d long")
    by = lambda d: F.element_at(F.create_map(*(F.lit(x) for kv in d.items() for x in kv)), F.bit_count("fp"))
    ends = lambda xs: F.array(*(F.lit(x) for x in xs))
    names = ["u", "v"] if close is None else ["u", "v", "d"]
    extra = ["more", "rest", "size"] if close is not None else []
    placed = distinct.select("fp", "rep", *extra, (by(first) + F.pmod(F.xxhash64("fp"), by(salts))).cast("int").alias("tile"))
    placed = placed.withColumns({"lo": F.get(ends(low), F.col("tile")), "hi": F.get(ends(high), F.col("tile"))})
    near = F.filter(F.sequence(F.lit(0), F.lit(tiles - 1)), lambda j: (F.get(ends(low), j) - F.col("hi") <= radius) & (F.col("lo") - F.get(ends(high), j) <= radius))
    dealt = placed.select("fp", "rep", *extra, "tile", F.explode(near).alias("other"))
    dealt = dealt.select((F.least("tile", "other").cast("long") * tiles + F.greatest("tile", "other")).alias("pair"), "tile", "fp", "rep", *extra)

    def compare(table: pa.Table) -> pa.Table:
        tile, fp, rep = (table.column(c).to_numpy() for c in ("tile", "fp", "rep"))
        order = np.argsort(tile, kind="stable")
        tile, fp, rep = tile[order], fp[order].view(np.uint64), rep[order]
        pair = table.column("pair")[0].as_py()
        alone = pair // tiles == pair % tiles
        n_first = len(fp) if alone else int((tile == tile[0]).sum())
        if not alone and n_first == len(fp):  # nothing is left of one of the tiles
            return pa.table({c: pa.array([], pa.int64()) for c in names})
        if close is None:
            u, v = tile_links(fp, rep, n_first, radius)
        else:
            more, size = table.column("more").to_numpy()[order].view(np.uint64), table.column("size").to_numpy()[order]
            rest = np.frombuffer(b"".join(table.column("rest").to_pylist()), np.uint64).reshape(len(fp), -1)[order]
            found = candidate_links(fp, more, rest, size, n_first, radius, close, share)
            i, j, d = np.array(found, np.int64).reshape(-1, 3).T
            u, v = rep[i], rep[j]
        release()
        return pa.table({"u": u, "v": v} if close is None else {"u": u, "v": v, "d": d})

    return dealt.groupBy("pair").applyInArrow(compare, ", ".join(f"{c} long" for c in names))


def near_duplicates(docs: DataFrame, words_in_shingle: int = SHINGLE_WORDS, radius: int = RADIUS) -> DataFrame:
    """One row ``(doc_id, fp, component_id)`` per row of ``docs(doc_id, text)``.

    Two documents link if their fingerprints differ in at most ``radius`` bits; ``component_id`` is the smallest doc_id
    that can be reached over links. Null, empty and blank texts have fingerprint zero and link like any other. Rows
    with a null doc_id get a fingerprint and a null component. Repeated rows give repeated results; rows that share
    a doc_id count as one document. An empty table gives an empty result. Other columns are ignored.
    """
    fps = stage(fingerprints(docs, words_in_shingle), "fp")
    distinct = stage(fps.filter("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep")), "fp-distinct")
    parts = connected_components(stage(links(distinct, radius), "links"))
    found = distinct.join(parts.withColumnRenamed("node", "rep"), "rep", "left")
    found = stage(found.select("fp", F.coalesce("component", "rep").alias("component_id")), "fp-component")
    out = fps.join(found, "fp", "left")
    return out.select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


# --- similar texts ----------------------------------------------------------------------------------------------------
#: Shingles of so many words, and the share of them that similar texts have in common.
SIMILAR_WORDS, SIMILARITY = 5, 0.8
#: Words of 64 bits in a fingerprint.
FINGERPRINT_WORDS = 8
#: Bits that either of the first two words may differ in (texts of similarity 0.8: 9.7 on average, three of a thousand
#: beyond this), and bits in all up to which texts are most likely similar, so that a forest of them is verified first.
WORD_RADIUS, CLOSE = 18, 40
#: Bits of all words that texts may differ in (similarity 0.8: 78 on average, standard deviation 8.1). Where a text has fewer
#: than FEW shingles, single shingles decide too many bits for that, and the first two words alone count.
REACH, FEW = 110, 24
#: Texts, and shingles of all of them, in a part of a block whose texts are compared.
BLOCK_ROWS, BLOCK_SHINGLES = 2048, 1 << 20
#: Bytes of text whose shingles a task holds while it verifies pairs, as one text is often part of many.
SHINGLES_HELD = 4 << 20
#: The increment and the two multipliers of the splitmix64 generator.
MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def _shingles(text: bytes, k: int) -> list[bytes]:
    words = text.lower().split()
    k = min(k, len(words))
    return [b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] if words else []


def _mixed(digests: np.ndarray) -> np.ndarray:
    """A row of FINGERPRINT_WORDS words for each of ``digests`` (two words a row, which come first): the others are mixed from them."""
    words = np.arange(2, FINGERPRINT_WORDS, dtype=np.uint64)
    x = digests[:, np.arange(2, FINGERPRINT_WORDS) % 2] + words * np.uint64(MIX[0])
    x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX[1])
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX[2])
    return np.concatenate([digests, x ^ (x >> np.uint64(31))], 1)


def _bits(words: np.ndarray) -> np.ndarray:
    return np.unpackbits(words.view(np.uint8).reshape(len(words), -1), axis=1)


def _ones(words: np.ndarray) -> np.ndarray:
    """How many rows of ``words`` have each bit set: bytes are summed for 255 rows at a time, which can't overflow them."""
    counts = np.zeros(64 * FINGERPRINT_WORDS, np.int64)
    for at in range(0, len(words), 255):
        counts += _bits(words[at : at + 255]).sum(0, dtype=np.uint8)
    return counts


def _wide_fingerprints(docs: DataFrame, k: int) -> DataFrame:
    """``(doc_id, fp, more, rest, same, size)``: the words of a fingerprint, a hash of all words of the text, and the number of
    its different shingles."""

    def run(batches):
        for batch in released(batches):
            texts = batch.column("text").cast(pa.binary())
            out = np.zeros((len(texts), FINGERPRINT_WORDS), np.uint64)
            same, different = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
            for row, text in enumerate(texts):
                words = (text.as_py() or b"").lower().split()
                joined = b" ".join(words)
                same[row] = np.uint64(xxhash.xxh64_intdigest(joined)).view(np.int64)
                if not words:
                    continue
                size = min(k, len(words))
                ends = [at - 1 for at in accumulate(len(w) + 1 for w in words)]
                starts = [0, *(at + 1 for at in ends)]
                n, counts, least = len(words) - size + 1, np.zeros(64 * FINGERPRINT_WORDS, np.int64), b"\xff" * 16
                seen: set[bytes] = set()
                for at in range(0, n, 1 << 14):
                    to = min(n, at + (1 << 14))
                    digests = [xxhash.xxh128_digest(joined[x:y], HASH_SEED) for x, y in zip(starts[at:to], ends[at + size - 1 : to + size - 1])]
                    least = min(least, *digests)
                    seen.update(digests)
                    counts += _ones(_mixed(np.frombuffer(b"".join(digests), np.uint64).reshape(-1, 2)))
                different[row] = len(seen)
                # the shingle of least hash decides ties, so that bits of short texts are ones as often as not
                tied = _bits(_mixed(np.frombuffer(least, np.uint64).reshape(1, 2)))[0]
                out[row] = np.packbits(np.where(2 * counts == n, tied, 2 * counts > n)).view(np.uint64)
            rest = pa.array([x.tobytes() for x in out[:, 2:]], pa.binary())
            first, second = (pa.array(out[:, c].copy().view(np.int64)) for c in (0, 1))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), first, second, rest, pa.array(same), pa.array(different)], names=["doc_id", "fp", "more", "rest", "same", "size"])

    return docs.mapInArrow(run, "doc_id long, fp long, more long, rest binary, same long, size long")


def _verified(edges: DataFrame, texts: DataFrame, k: int, similarity: float) -> DataFrame:
    """``(u, v, good)``: whether the texts of each edge have ``similarity``, shared over all different shingles."""

    def run(batches):
        for batch in released(batches):
            keep, held, room = [], {}, SHINGLES_HELD

            def shingles(column: str, row: int) -> set[bytes]:
                nonlocal room
                doc = batch.column("u" if column == "a" else "v")[row].as_py()
                if doc not in held:
                    text = batch.column(column)[row].cast(pa.binary()).as_py() or b""
                    if len(text) > room:
                        held.clear()
                        room = SHINGLES_HELD
                    room -= len(text)
                    held[doc] = set(_shingles(text, k))
                return held[doc]

            for row in range(batch.num_rows):
                x, y = shingles("a", row), shingles("b", row)
                common = len(x & y)
                keep.append(common >= similarity * (len(x) + len(y) - common) - 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v"), pa.array(keep, pa.bool_())], names=["u", "v", "good"])

    left, right = texts.select(F.col("rep").alias("u"), F.col("text").alias("a")), texts.select(F.col("rep").alias("v"), F.col("text").alias("b"))
    return edges.join(left, "u").join(right, "v").select("u", "v", "a", "b").mapInArrow(run, "u long, v long, good boolean")


def _checked(rows: DataFrame, edges: DataFrame, k: int, similarity: float) -> DataFrame:
    """``_verified`` for ``edges`` between documents of ``rows``."""
    ends = edges.select(F.col("u").alias("rep")).union(edges.select("v")).distinct()
    texts = rows.join(ends, rows["doc_id"] == ends["rep"]).select("rep", "text")
    return _verified(edges, texts, k, similarity)


def _shingle_sets(rows: DataFrame, k: int) -> DataFrame:
    """``(rep, same, hashes)``: the different shingles of each text as sorted 64-bit hashes."""

    def run(batches):
        for batch in released(batches):
            same, sets = [], []
            for text in batch.column("text").cast(pa.binary()):
                words = (text.as_py() or b"").lower().split()
                joined = b" ".join(words)
                same.append(int(np.uint64(xxhash.xxh64_intdigest(joined)).view(np.int64)))
                size = min(k, len(words))
                ends = [at - 1 for at in accumulate(len(w) + 1 for w in words)]
                starts = [0, *(at + 1 for at in ends)]
                n = len(words) - size + 1 if words else 0
                hashes = np.fromiter((xxhash.xxh64_intdigest(joined[x:y], HASH_SEED) for x, y in zip(starts[:n], ends[size - 1 :])), np.uint64, n)
                sets.append(np.unique(hashes).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(same, pa.int64()), pa.array(sets, pa.binary())], names=["rep", "same", "hashes"])

    return rows.mapInArrow(run, "rep long, same long, hashes binary")


def _block_links(rows: DataFrame, members: DataFrame, k: int, similarity: float) -> DataFrame:
    """Edges ``(u, v)`` that connect all similar ``_candidates`` among ``members`` of one component that have different labels.

    Candidates never cross components, so components of one label need nothing, and small ones share a block. A component
    beyond BLOCK_ROWS or BLOCK_SHINGLES is cut into parts, of which each two are compared in a group of its own. A group
    gives a spanning forest, never all of its pairs.
    """
    weight = F.greatest(F.ceil(F.sum("size") / BLOCK_SHINGLES), F.ceil(F.count(F.lit(1)) / BLOCK_ROWS), F.lit(1)).cast("long")
    several = members.groupBy("component").agg(weight.alias("parts"), F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high")
    blocks = stage(members.join(several.select("component", "parts"), "component"), "wide-blocks")
    blocks_n = blocks.filter("parts = 1").agg(weight).first()[0]
    alone = F.col("parts") == 1
    block = F.when(alone, F.pmod(F.xxhash64("component"), F.lit(blocks_n))).otherwise(F.lit(-1))
    sets = _shingle_sets(rows.join(blocks.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi"), k)
    dealt = blocks.join(sets.dropDuplicates(["rep", "same"]), ["rep", "same"])
    dealt = dealt.withColumns({"block": block, "whole": F.when(alone, F.lit(-1)).otherwise(F.col("component")), "part": F.pmod(F.xxhash64("rep", "same"), F.col("parts"))})
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    pair = F.least("part", "other") * F.col("parts") + F.greatest("part", "other")
    dealt = dealt.select("whole", "block", pair.alias("pair"), "part", "parts", "rep", "label", "fp", "more", "rest", "hashes")

    def compare(table: pa.Table) -> pa.Table:
        part = table.column("part").to_numpy()
        order = np.argsort(part, kind="stable")
        part, rep, label = part[order], table.column("rep").to_numpy()[order], table.column("label").to_numpy()[order]
        parts, pair = table.column("parts")[0].as_py(), table.column("pair")[0].as_py()
        same = pair // parts == pair % parts
        n_first = len(part) if same else int((part == part[0]).sum())
        if not same and n_first == len(part):  # nothing is in one of the parts
            return pa.table({c: pa.array([], pa.int64()) for c in ("u", "v")})
        fp, more = (table.column(c).to_numpy()[order].view(np.uint64) for c in ("fp", "more"))
        rest = np.frombuffer(b"".join(table.column("rest").to_pylist()), np.uint64).reshape(len(part), -1)[order]
        hashes = table.column("hashes")
        sets = [np.frombuffer(hashes[at].as_py(), np.uint64) for at in order.tolist()]
        i, j = np.array(similar_links(fp, more, rest, sets, n_first, WORD_RADIUS, similarity, label), np.int64).reshape(-1, 2).T
        release()
        return pa.table({"u": rep[i], "v": rep[j]})

    return dealt.groupBy("whole", "block", "pair").applyInArrow(compare, "u long, v long")


def similar_documents(docs: DataFrame, words_in_shingle: int = SIMILAR_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """``(doc_id, component_id)`` per row of ``docs(doc_id, text)``: classes of texts that share ``similarity`` of their shingles.

    Fingerprints are compared tile by tile as in ``near_duplicates``, but of 512 bits and within a radius that similarity
    0.8 needs. Each two tiles give a spanning forest of their very close pairs, which are verified on the texts, and one of
    all pairs within the radius. Texts that the latter connects are compared by their shingles (64-bit hashes) in
    blocks, where what is linked already isn't compared again. So no step gives all pairs of a group, and every pair within the
    radius is linked or compared. Texts of the same words are one; null, empty and blank texts are one class. Rows with a null
    doc_id get a null component; rows that share a doc_id are in the class of either. Other columns are ignored; an empty
    table gives an empty result.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    fps = stage(_wide_fingerprints(rows, words_in_shingle), "wide-fp")
    distinct = stage(fps.filter("doc_id is not null").groupBy("fp", "more", "rest", "same").agg(F.min("doc_id").alias("rep"), F.max("size").alias("size")), "wide-distinct")
    ends = F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")
    found = stage(links(distinct, WORD_RADIUS, CLOSE, similarity).groupBy(*ends).agg(F.min("d").alias("d")), "wide-links")
    good = stage(_checked(rows, found.filter("d = 0").select("u", "v"), words_in_shingle, similarity).filter("good").select("u", "v"), "wide-close")
    trees = stage(connected_components(good), "wide-trees").withColumnRenamed("component", "label")
    loose = stage(connected_components(found.select("u", "v")), "wide-loose").withColumnRenamed("node", "rep")
    members = distinct.join(loose, "rep").join(trees.withColumnRenamed("node", "rep"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    more = stage(_block_links(rows, members, words_in_shingle, similarity), "wide-more")
    every = more.select(*ends).union(trees.select(F.col("node").alias("u"), F.col("label").alias("v"))).distinct()
    parts = stage(connected_components(every), "wide-parts")
    classes = distinct.join(parts.withColumnRenamed("node", "rep"), "rep", "left").select("fp", "more", "rest", "same", F.coalesce("component", "rep").alias("component_id"))
    return fps.join(classes, ["fp", "more", "rest", "same"], "left").select("doc_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def keep_one_of_each(docs: DataFrame, **parameters) -> DataFrame:
    """The rows of ``docs``, with all their columns, but for those whose class of similar texts has a smaller doc_id.

    Rows with a null doc_id stay.
    """
    found = similar_documents(docs, **parameters)
    gone = found.filter("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"].cast("long") == gone["_gone"], "left_anti")
