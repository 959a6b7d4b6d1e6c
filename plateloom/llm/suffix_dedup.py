"""Removal of repeated byte strings by suffix arrays of shards, built by induced sorting.

Anchors bring equal strings together. In every string of LENGTH bytes the 16 bytes of least hash are its anchor, so that
equal strings have equal anchors, and neighbouring strings mostly share one. Strings around an anchor that is in one document
only can't repeat; what lies around the others (their contexts) goes to a shard by anchor. A shard's suffix
array and the common prefixes of neighbours in it show which strings are equal, byte for byte.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plateloom.llm.common import stage
from plateloom.llm.lm import pack_arrays, unpack_arrays
from plateloom.llm.memory import release, released

LENGTH = 50
GRAM = 16
#: Of how much text a part holds the documents, a shard the contexts and an anchors' shard the anchors, about; work at once; contexts
#: that one suffix array holds, about. Each part sends to each shard, so there are few of these.
PART_BYTES, SHARD_BYTES, ANCHOR_BYTES, WORK_BYTES, ARRAY_BYTES = 8 << 20, 12 << 20, 32 << 20, 1 << 20, 1 << 19
LEAST_PARTS = 16
#: Strings in the longest run with one anchor.
RUN = 4096


# --- induced sorting --------------------------------------------------------------------------------------------------
def rank_doubling(s: np.ndarray, depth: int | None = None) -> np.ndarray:
    """The suffix array of ``s`` by doubling ranks; with ``depth``, suffixes that agree so far may stand in any order."""
    n = len(s)
    rank = np.unique(s, return_inverse=True)[1].astype(np.int64)
    order, h = np.argsort(rank, kind="stable"), 1
    while n and h < (depth or n) and rank[order[-1]] < n - 1:
        after = np.zeros(n, np.int64)
        after[: n - h] = rank[h:] + 1 if h < n else 0
        key = rank * (n + 1) + after
        order = np.argsort(key)
        ordered = key[order]
        rank[order] = np.cumsum(np.r_[0, ordered[1:] != ordered[:-1]])
        h *= 2
    return order


class Types(NamedTuple):
    is_s: np.ndarray
    lms: np.ndarray


def classify(s: np.ndarray) -> Types:
    """Which suffixes are smaller than the next (S-type), and the leftmost of each run of these."""
    n = len(s)
    differs = np.flatnonzero(s[1:] != s[:-1])
    # a suffix is as the next one that differs in its first symbol; the last run is L-type
    at = np.searchsorted(differs, np.arange(n))
    has = at < len(differs)
    where = differs[np.minimum(at, max(len(differs) - 1, 0))] if len(differs) else np.zeros(n, np.int64)
    is_s = np.zeros(n, bool)
    is_s[has] = s[where[has]] < s[where[has] + 1]
    lms = np.flatnonzero(is_s[1:] & ~is_s[:-1]) + 1
    return Types(is_s, lms)


def induce(s: np.ndarray, types: Types, seeds: np.ndarray, sigma: int) -> np.ndarray:
    """All suffixes in order, induced from the leftmost S-type ones in order."""
    n, is_s = len(s), types.is_s
    ends = np.cumsum(np.bincount(s, minlength=sigma))
    begins = np.r_[0, ends[:-1]]
    sa = np.full(n, -1, np.int64)
    seed_ends = np.searchsorted(s[seeds], np.arange(sigma + 1))

    def before_of(block: np.ndarray, s_type: bool) -> tuple[np.ndarray, np.ndarray]:
        before = block[block > 0] - 1
        before = before[is_s[before] == s_type]
        return before, s[before]

    def spread(before: np.ndarray, symbols: np.ndarray, at: np.ndarray, step: int) -> None:
        if not len(before):
            return
        order = np.argsort(symbols, kind="stable")
        before, symbols = before[order], symbols[order]
        first = np.flatnonzero(np.r_[True, symbols[1:] != symbols[:-1]])
        sizes = np.diff(np.r_[first, len(symbols)])
        within = np.arange(len(symbols)) - np.repeat(first, sizes)
        own = symbols[first]
        sa[np.repeat(at[own], sizes) + step * within] = before
        at[own] += step * sizes

    # from the left: L-types go to the heads of their buckets
    heads = begins.copy()
    sa[heads[s[-1]]] = n - 1  # the last suffix comes before others of its symbol: the end is smaller than anything
    heads[s[-1]] += 1
    for c in range(sigma):
        done = begins[c]
        while done < heads[c]:
            block, done = sa[done : heads[c]], heads[c]
            before, symbols = before_of(block, False)
            same = symbols == c
            if same.any():
                own = before[same]
                sa[heads[c] : heads[c] + len(own)] = own
                heads[c] += len(own)
                before, symbols = before[~same], symbols[~same]
            spread(before, symbols, heads, 1)
        spread(*before_of(seeds[seed_ends[c] : seed_ends[c + 1]], False), heads, 1)
    # from the right: S-types go to the tails; the seeds' own places are filled anew
    tails = ends - 1
    for c in range(sigma - 1, -1, -1):
        done = ends[c] - 1
        while done > tails[c]:
            block, done = sa[tails[c] + 1 : done + 1][::-1], tails[c]
            before, symbols = before_of(block, True)
            same = symbols == c
            if same.any():
                own = before[same]
                sa[tails[c] - len(own) + 1 : tails[c] + 1] = own[::-1]
                tails[c] -= len(own)
                before, symbols = before[~same], symbols[~same]
            spread(before, symbols, tails, -1)
        spread(*before_of(sa[begins[c] : heads[c]][::-1], True), tails, -1)
    return sa


def _names(s: np.ndarray, types: Types, ordered: np.ndarray) -> np.ndarray:
    """A number for each leftmost S-type suffix, in order of the text: equal for equal substrings up to the next one."""
    place = np.full(len(s) + 1, -1, np.int64)
    place[types.lms] = np.arange(len(types.lms))
    stops = np.r_[types.lms[1:], len(s)]
    size = (stops - types.lms)[place[ordered]]
    a, b = ordered[:-1], ordered[1:]
    same = (size[:-1] == size[1:]) & (a + size[:-1] < len(s)) & (b + size[1:] < len(s))
    live = np.flatnonzero(same)
    k = 0
    while len(live):
        # up to and with the first symbol of the next one
        live = live[k <= size[live]]
        differs = s[a[live] + k] != s[b[live] + k]
        same[live[differs]] = False
        live = live[~differs]
        k += 1
        live = live[k <= size[live]]
    named = np.cumsum(np.r_[0, ~same])
    out = np.empty(len(ordered), np.int64)
    out[place[ordered]] = named
    return out


def suffix_array(s: np.ndarray, sigma: int | None = None, depth: int | None = None) -> np.ndarray:
    """The suffix array of an array of small integers by induced sorting.

    Suffixes are classified; the substrings between leftmost S-type suffixes are sorted by inducing from those in any order,
    and named; their string of names is sorted in the same way, or by doubling where it has too many names for
    buckets to be handled in bulk; its order induces that of all suffixes. With ``depth`` suffixes that agree in so many
    symbols may stand in any order.
    """
    s = np.asarray(s)
    n = len(s)
    if n < 2:
        return np.arange(n)
    sigma = sigma or int(s.max()) + 1
    types = classify(s)
    if not len(types.lms):
        return induce(s, types, types.lms, sigma)
    rough = types.lms[np.argsort(s[types.lms], kind="stable")]
    first = induce(s, types, rough, sigma)
    leftmost = np.zeros(n, bool)
    leftmost[types.lms] = True
    names = _names(s, types, first[leftmost[first]])
    most = int(names.max()) + 1
    if most == len(names):
        order = np.argsort(names)
    elif most <= 300:
        order = suffix_array(names, most, depth)
    else:
        order = rank_doubling(names, None if depth is None else depth // 2 + 1)
    return induce(s, types, types.lms[order], sigma)


def permuted_common_prefixes(data: np.ndarray, sa: np.ndarray, most: int, exact: bool = True) -> np.ndarray:
    """In order of the text, the bytes, up to ``most``, that a suffix shares with the one before it in the array.

    Eight bytes are compared at a time. Without ``exact`` a prefix of fewer than ``most`` bytes may be given as shorter.
    """
    n = len(data)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    out = np.zeros(n, np.int32)
    live = np.flatnonzero(before >= 0)
    words = np.ndarray((n + 1,), np.uint64, np.r_[data, np.zeros(8, np.uint8)], strides=(1,))
    k = 0
    while k < most and len(live):
        # the last step may go over bytes again
        at = min(k, most - 8) if most >= 8 and not exact else k
        a, b = live + at, before[live] + at
        equal = np.maximum(a, b) + 8 <= n
        equal[equal] = words[a[equal]] == words[b[equal]]
        if exact:
            # the rest ends within these eight bytes
            rest, ra, rb = live[~equal], a[~equal], b[~equal]
            for j in range(8):
                ok = (ra < n) & (rb < n)
                ok[ok] = data[ra[ok]] == data[rb[ok]]
                rest, ra, rb = rest[ok], ra[ok] + 1, rb[ok] + 1
                out[rest] = k + j + 1
        live = live[equal]
        k += 8
        out[live] = k
    return np.minimum(out, most)


# --- anchors ----------------------------------------------------------------------------------------------------------
class Runs(NamedTuple):
    """Neighbouring strings with one anchor: first and last start, the anchor's hash, the document."""

    first: np.ndarray
    last: np.ndarray
    anchor: np.ndarray
    doc: np.ndarray


def anchor_runs(data: np.ndarray, ends: np.ndarray) -> Runs:
    """Of texts that stand behind each other in less than 16 MB and end at ``ends``."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < LENGTH:
        return Runs(none, none, none.astype(np.uint64), none)
    x = data.astype(np.uint64) + np.uint64(0x9E37)
    for step in (1, 2, 4, 8):
        x = x[:-step] * np.uint64((0x9E3779B97F4A7C15 * (2 * step + 1)) & (2**64 - 1) | 1) + x[step:]
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    x >>= np.uint64(24)
    for step in (1, 2, 4, 8, 16):
        x = np.minimum(x[:-step], x[step:])
    x = np.minimum(x[:-3], x[3:])  # 35 neighbours
    begins = np.r_[0, ends[:-1]]
    long = ends - begins >= LENGTH
    change = np.zeros(len(x) + 1, np.int8)
    change[begins[long]] += 1
    change[ends[long] - LENGTH + 1] -= 1
    valid = np.cumsum(change[:-1], dtype=np.int8) > 0
    joined = np.r_[False, (x[1:] == x[:-1]) & valid[1:] & valid[:-1]]
    first = np.flatnonzero(valid & ~joined)
    last = np.flatnonzero(valid & ~np.r_[joined[1:], False])
    # strings with one least hash stay together wherever it stands, so periodic text is a single run, which comes in equal pieces
    pieces = (last - first) // RUN + 1
    first = np.repeat(first, pieces) + (np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * RUN
    last = np.minimum(first + RUN - 1, np.repeat(last, pieces))
    return Runs(first, last, x[first], np.searchsorted(ends, first, "right"))


def _places(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of pieces, behind each other."""
    return np.arange(int(sizes.sum())) + np.repeat(first - (np.cumsum(sizes) - sizes), sizes)


def _gather(data: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Pieces of ``data`` behind each other."""
    if len(first) * 256 < int(sizes.sum()):
        return np.concatenate([data[a : a + n] for a, n in zip(first.tolist(), sizes.tolist())])
    offsets = np.r_[0, np.cumsum(sizes)]
    return data[np.arange(offsets[-1]) + np.repeat(first - offsets[:-1], sizes)]


def _binary(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    offsets = np.r_[0, np.cumsum(sizes)].astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


class Texts(NamedTuple):
    ids: np.ndarray
    data: np.ndarray
    ends: np.ndarray

    def works(self):
        """Slices with WORK_BYTES of text or one document each, as (first document, data, ends)."""
        at = 0
        while at < len(self.ids):
            begin = int(self.ends[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(self.ends, begin + WORK_BYTES, "right")))
            yield at, begin, self.data[begin : self.ends[to - 1]], self.ends[at:to] - begin
            at = to


def _runs(texts: Texts):
    """``anchor_runs`` of all texts, work by work, in places of the whole; a document of 12 MB or more comes in pieces."""
    for at, begin, data, ends in texts.works():
        if len(data) < 1 << 24:
            r = anchor_runs(data, ends)
            yield Runs(r.first + begin, r.last + begin, r.anchor, r.doc + at)
            continue
        step = 4 << 20
        for piece in range(0, len(data) - LENGTH + 1, step):  # strings that begin in the piece; a run may be cut in two
            own = data[piece : min(len(data), piece + step + LENGTH - 1)]
            r = anchor_runs(own, np.array([len(own)]))
            yield Runs(r.first + begin + piece, r.last + begin + piece, r.anchor, r.doc + at)


def _part_of(ids: np.ndarray, parts: int) -> np.ndarray:
    mixed = ids.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)


def _shard_of(anchor: np.ndarray, shards: int) -> np.ndarray:
    return (anchor % np.uint64(shards)).astype(np.int64)


def _texts_of(batch: pa.RecordBatch) -> Texts:
    column = pc.fill_null(batch.column("text").cast(pa.large_binary()), b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return Texts(batch.column("doc_id").to_numpy(), raw[offsets[0] : offsets[-1]], (offsets[1:] - offsets[0]).astype(np.int64))


def _take(texts: Texts, rows: np.ndarray) -> Texts:
    begins = np.r_[0, texts.ends[:-1]][rows]
    sizes = texts.ends[rows] - begins
    return Texts(texts.ids[rows], _gather(texts.data, begins, sizes), np.cumsum(sizes))


def _packed(arrays: list[np.ndarray]) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(pack_arrays(arrays))


def _unpacked(payload: bytes) -> list[np.ndarray]:
    return unpack_arrays(np.frombuffer(zstandard.ZstdDecompressor().decompress(payload), np.uint8))


def _rows(columns: dict[str, tuple[pa.DataType, list]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, kind) for kind, v in columns.values()], names=list(columns))


# --- the steps --------------------------------------------------------------------------------------------------------
def _deal(parts: int):
    """Documents packed by part."""

    def run(batches):
        for batch in released(batches):
            texts = _texts_of(batch)
            own = _part_of(texts.ids, parts)
            found = [(int(p), _take(texts, np.flatnonzero(own == p))) for p in np.unique(own)]
            yield _rows({"part": (pa.int32(), [p for p, _ in found]), "kind": (pa.int32(), [0] * len(found)), "payload": (pa.binary(), [_packed([t.ids, t.data, t.ends]) for _, t in found])})

    return run


def _anchors(parts: int, shards: int):
    """The different anchors of a batch by shard and part, and which are in several of its documents."""

    def run(batches):
        for batch in released(batches):
            texts = _texts_of(batch)
            own = _part_of(texts.ids, parts)
            found: list[Runs] = [*_runs(texts)]
            anchor, doc = (np.concatenate([getattr(r, c) for r in found]) if found else np.zeros(0, np.uint64) for c in ("anchor", "doc"))
            # (part, anchor, document) without repeats, then (part, anchor)
            part = own[doc.astype(np.int64)].astype(np.uint64)
            key = (part << np.uint64(40)) | anchor.astype(np.uint64)
            order = np.argsort(key)
            key, doc = key[order], doc[order]
            new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
            several = np.maximum.reduceat(doc, new) != np.minimum.reduceat(doc, new) if len(key) else np.zeros(0, bool)
            key = key[new]
            part, anchor = (key >> np.uint64(40)).astype(np.int64), key & np.uint64((1 << 40) - 1)
            of = _shard_of(anchor, shards)
            order = np.argsort(of.astype(np.uint16) if shards < 1 << 16 else of, kind="stable")
            of, part, anchor, several = of[order], part[order], anchor[order], several[order]
            starts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) if len(of) else np.zeros(0, np.int64)
            stops = np.r_[starts[1:], len(of)]
            payloads = []
            for a, b in zip(starts.tolist(), stops.tolist()):
                narrow = np.ascontiguousarray(anchor[a:b].view(np.uint8).reshape(-1, 8)[:, :5]).ravel()
                # within a shard anchors stand by part
                first = np.flatnonzero(np.r_[True, part[a + 1 : b] != part[a : b - 1]])
                payloads.append(pack_arrays([narrow, np.packbits(several[a:b]), part[a:b][first].astype(np.uint32), np.diff(np.r_[first, b - a]).astype(np.uint32)]))
            yield _rows({"shard": (pa.int32(), of[starts].tolist()), "payload": (pa.binary(), payloads)})

    return run


def _repeated(table: pa.Table) -> pa.Table:
    """For each part, its anchors that are in several documents."""
    every, several, part = [], [], []
    for payload in table.column("payload"):
        narrow, bits, parts, sizes = unpack_arrays(np.frombuffer(payload.as_py(), np.uint8))
        wide = np.zeros((len(narrow) // 5, 8), np.uint8)
        wide[:, :5] = narrow.reshape(-1, 5)
        every.append(wide.view(np.uint64).ravel())
        several.append(np.unpackbits(bits, count=len(wide)).astype(bool))
        part.append(np.repeat(parts, sizes))
    anchor, several, part = np.concatenate(every), np.concatenate(several), np.concatenate(part)
    del every
    order = np.lexsort((part, anchor))
    anchor, several, part = anchor[order], several[order], part[order]
    first = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
    sizes = np.diff(np.r_[first, len(anchor)])
    keep = np.repeat((sizes > 1) | np.logical_or.reduceat(several, first), sizes)
    keep[1:] &= ~(keep[:-1] & (anchor[1:] == anchor[:-1]) & (part[1:] == part[:-1]))
    anchor, part = anchor[keep], part[keep]
    order = np.argsort(part, kind="stable")
    anchor, part = anchor[order], part[order]
    used, first = np.unique(part, return_index=True)
    payloads = [_packed([anchor[a:b]]) for a, b in zip(first.tolist(), [*first[1:].tolist(), len(part)])]
    release()
    return pa.table({"part": pa.array(used.tolist(), pa.int32()), "kind": pa.array([1] * len(used), pa.int32()), "payload": pa.array(payloads, pa.binary())})


class Contexts(NamedTuple):
    """What lies around repeated anchors in a part: instances, and the different ones of each shard in a fixed order."""

    first: np.ndarray  # of each instance, its first string's place
    doc: np.ndarray
    code: np.ndarray  # which of the different contexts it is
    data: np.ndarray
    sizes: np.ndarray
    least: np.ndarray  # the smallest doc_id with this context
    anchor: np.ndarray
    shard: np.ndarray


def _part_texts(table: pa.Table) -> Texts:
    """A part's documents in a fixed order."""
    ids, datas, ends = [], [], []
    for kind, payload in zip(table.column("kind").to_pylist(), table.column("payload")):
        if kind == 0:
            i, d, e = _unpacked(payload.as_py())
            ids.append(i)
            ends.append(e + sum(len(x) for x in datas))
            datas.append(d)
    texts = Texts(np.concatenate(ids), np.concatenate(datas), np.concatenate(ends))
    begins = np.r_[0, texts.ends[:-1]]
    if len(np.unique(texts.ids)) == len(texts.ids):
        return _take(texts, np.argsort(texts.ids))
    return _take(texts, np.array(sorted(range(len(texts.ids)), key=lambda k: (texts.ids[k], texts.data[begins[k] : texts.ends[k]].tobytes()))))


def _contexts(texts: Texts, known: np.ndarray, shards: int) -> Contexts:
    runs = []
    for r in _runs(texts):
        if not len(known):
            break
        keep = known[np.minimum(np.searchsorted(known, r.anchor), len(known) - 1)] == r.anchor
        runs.append(Runs(*(c[keep] for c in r)))
    empty = np.zeros(0, np.int64)
    first, last, anchor, doc = (np.concatenate([getattr(r, c) for r in runs]) if runs else empty for c in Runs._fields)
    sizes = last - first + LENGTH
    coded = _binary(_gather(texts.data, first, sizes), sizes).dictionary_encode()
    code, different = coded.indices.to_numpy().astype(np.int64), coded.dictionary
    n = len(different)
    least = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(least, code, texts.ids[doc])
    own = np.zeros(n, np.uint64)
    own[code] = anchor.astype(np.uint64)
    offsets = np.frombuffer(different.buffers()[1], np.int64)[: n + 1] if n else np.zeros(1, np.int64)
    data = np.frombuffer(different.buffers()[2], np.uint8)[: offsets[-1]] if n else np.zeros(0, np.uint8)
    return Contexts(first, doc, code, data, np.diff(offsets), least, own, _shard_of(own, shards))


def _by_shard(c: Contexts) -> dict[int, np.ndarray]:
    """The contexts of each shard, in order."""
    order = np.argsort(c.shard, kind="stable")
    used, first = np.unique(c.shard[order], return_index=True)
    return dict(zip(used.tolist(), np.split(order, first[1:])))


def _known(table: pa.Table) -> np.ndarray:
    lists = [_unpacked(p.as_py())[0] for k, p in zip(table.column("kind").to_pylist(), table.column("payload")) if k == 1]
    return np.unique(np.concatenate(lists)) if lists else np.zeros(0, np.uint64)


def _send(shards: int):
    """A part's different contexts, with the smallest doc_id of each, to their shards."""
    kinds = {"shard": pa.int32(), "part": pa.int32(), "payload": pa.binary()}

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: dict = {c: [] for c in kinds}
        if left.num_rows and right.num_rows:
            part = left.column("part")[0].as_py()
            c = _contexts(_part_texts(left), _known(right), shards)
            begins = np.r_[0, np.cumsum(c.sizes)[:-1]] if len(c.sizes) else c.sizes
            for s, rows in _by_shard(c).items():
                out["shard"].append(s)
                out["part"].append(part)
                out["payload"].append(_packed([_gather(c.data, begins[rows], c.sizes[rows]), c.sizes[rows].astype(np.uint32), c.least[rows], c.anchor[rows]]))
        release()
        return pa.table({k: pa.array(v, kinds[k]) for k, v in out.items()})

    return run


def earlier_strings(data: np.ndarray, sizes: np.ndarray, least: np.ndarray) -> np.ndarray:
    """For each string of LENGTH bytes in pieces of ``data``, piece by piece: the smallest ``least`` of a piece that has it."""
    n = len(sizes)
    # pieces between separators, which are smaller than any byte
    symbols = np.zeros(len(data) + n, np.uint16)
    begins = np.r_[0, np.cumsum(sizes + 1)[:-1]] if n else np.zeros(0, np.int64)
    of = np.repeat(np.arange(n), sizes)
    symbols[np.arange(len(data)) + of] = data.astype(np.uint16) + 1
    used = np.unique(symbols)
    small_of = np.zeros(257, np.uint16)
    small_of[used] = np.arange(len(used))
    small = small_of[symbols]
    sa = suffix_array(small, len(used), LENGTH)
    # prefixes are compared by byte; a separator can't be within a string that counts
    prefixes = permuted_common_prefixes((np.maximum(symbols, 1) - 1).astype(np.uint8), sa, LENGTH, exact=False)
    counts = sizes - LENGTH + 1
    starts = np.arange(counts.sum()) + np.repeat(begins - np.r_[0, np.cumsum(counts)[:-1]], counts) if n else np.zeros(0, np.int64)
    number = np.full(len(symbols), -1, np.int64)
    number[starts] = np.arange(len(starts))
    ordered = sa[number[sa] >= 0]
    new = prefixes[ordered] < LENGTH
    if len(new):
        new[0] = True
    owner = np.repeat(least, counts)
    groups = np.flatnonzero(new)
    smallest = np.minimum.reduceat(owner[number[ordered]], groups) if len(groups) else owner
    out = np.empty(len(starts), np.int64)
    out[number[ordered]] = np.repeat(smallest, np.diff(np.r_[groups, len(ordered)]))
    return out


def _compare(table: pa.Table) -> pa.Table:
    """For each part's contexts, string by string, whether a document with a smaller id than any of the part's has it."""
    shard = table.column("shard")[0].as_py()
    parts = table.column("part").to_pylist()
    lists = [_unpacked(p.as_py()) for p in table.column("payload")]
    sizes = np.concatenate([b[1] for b in lists]).astype(np.int64)
    least = np.concatenate([b[2] for b in lists])
    coded = _binary(np.concatenate([b[0] for b in lists]), sizes).dictionary_encode()
    code, different = coded.indices.to_numpy().astype(np.int64), coded.dictionary
    offsets = np.frombuffer(different.buffers()[1], np.int64)[: len(different) + 1]
    own = np.full(len(different), np.iinfo(np.int64).max)
    np.minimum.at(own, code, least)
    anchor = np.zeros(len(different), np.uint64)
    anchor[code] = np.concatenate([b[3] for b in lists])
    sizes = np.diff(offsets)
    counts = sizes - LENGTH + 1
    begins = np.r_[0, np.cumsum(counts)[:-1]]
    # all strings of a context have its anchor: where no other context has it, no other has the strings
    found = np.repeat(own, counts)
    _, of, alike = np.unique(anchor, return_inverse=True, return_counts=True)
    rows = np.flatnonzero(alike[of] > 1)
    rows = rows[np.argsort(of[rows], kind="stable")]
    upto, last = np.cumsum(sizes[rows]), np.flatnonzero(np.r_[of[rows][1:] != of[rows][:-1], True][: len(rows)]) + 1
    at = 0
    while at < len(rows):
        # an array of whole anchors
        to = int(last[min(np.searchsorted(last, max(at + 1, np.searchsorted(upto, (upto[at - 1] if at else 0) + ARRAY_BYTES, "right"))), len(last) - 1)])
        some, at = rows[at:to], to
        data = _gather(np.frombuffer(different.buffers()[2], np.uint8), offsets[:-1][some], sizes[some])
        found[_places(begins[some], counts[some])] = earlier_strings(data, sizes[some], own[some])
    payloads, k = [], 0
    for b in lists:
        rows = code[k : k + len(b[1])]
        strings = _gather(found, begins[rows], counts[rows])
        earlier = strings < np.repeat(b[2], counts[rows])
        payloads.append(_packed([np.array([shard], np.int64), np.packbits(earlier)]))
        k += len(b[1])
    release()
    return pa.table({"part": pa.array(parts, pa.int32()), "kind": pa.array([2] * len(parts), pa.int32()), "payload": pa.array(payloads, pa.binary())})


_OUT = "doc_id long, n_bytes long, kept binary, spans array<struct<start:long,stop:long>>"
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))


def _remove(shards: int):
    """A part's documents without what documents of smaller id have."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table({"doc_id": pa.array([], pa.int64()), "n_bytes": pa.array([], pa.int64()), "kept": pa.array([], pa.binary()), "spans": pa.array([], _SPANS)})
        texts = _part_texts(left)
        removed = np.zeros(len(texts.data), bool)  # at first, where a string begins that goes
        if right.num_rows:
            c = _contexts(texts, _known(right), shards)
            counts = c.sizes - LENGTH + 1
            begins = np.r_[0, np.cumsum(counts)[:-1]] if len(counts) else counts
            earlier = np.zeros(int(counts.sum()), bool)
            by_shard = _by_shard(c)
            for kind, payload in zip(right.column("kind").to_pylist(), right.column("payload")):
                if kind == 2:
                    shard, bits = _unpacked(payload.as_py())
                    rows = by_shard[int(shard[0])]
                    own = np.unpackbits(bits, count=int(counts[rows].sum())).astype(bool)
                    earlier[_places(begins[rows], counts[rows])] = own
            upto = np.cumsum(counts[c.code])
            at = 0
            while at < len(c.first):
                to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + WORK_BYTES, "right")))
                code, doc, first = c.code[at:to], c.doc[at:to], c.first[at:to]
                gone = _gather(earlier, begins[code], counts[code])
                # within the part only the document of smallest id keeps a context
                gone |= np.repeat(texts.ids[doc] > c.least[code], counts[code])
                place = np.arange(len(gone)) + np.repeat(first - np.r_[0, np.cumsum(counts[code])[:-1]], counts[code])
                removed[place[gone]] = True
                at = to
        # a byte goes if one of the LENGTH strings that end with it or later, and begin with it or before, does
        for step in (1, 2, 4, 8, 16, LENGTH - 32):
            removed[step:] |= removed[:-step].copy()
        begins = np.r_[0, texts.ends[:-1]]
        sizes = np.zeros(len(texts.ids), np.int64)
        some = np.flatnonzero(texts.ends > begins)
        sizes[some] = np.add.reduceat(~removed, begins[some], dtype=np.int64) if len(some) else 0
        kept = _binary(texts.data[~removed], sizes).cast(pa.binary())
        # runs of removed bytes; a run ends with its document
        starts = removed & ~np.r_[False, removed[:-1]]
        inner = begins[(begins < len(removed))]
        starts[inner] = removed[inner]
        stops = removed & ~np.r_[removed[1:], False]
        outer = texts.ends[texts.ends > 0] - 1
        stops[outer] = removed[outer]
        a, b = np.flatnonzero(starts), np.flatnonzero(stops) + 1
        owner = np.searchsorted(texts.ends, a, "right")
        flat = pa.StructArray.from_arrays([pa.array(a - begins[owner]), pa.array(b - begins[owner])], fields=list(_SPANS.value_type))
        spans = pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(len(texts.ids) + 1)).astype(np.int32)), flat)
        return pa.table({"doc_id": texts.ids, "n_bytes": texts.ends - begins, "kept": kept, "spans": spans.cast(_SPANS)})

    return run


def dedup_bytes(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_bytes, kept binary, spans)`` for each row of ``docs(doc_id, text)``.

    Every byte goes that a string of LENGTH bytes covers which also starts in a document of smaller doc_id; ``spans`` are the
    maximal runs of these (start, stop). Strings are those of the input, and don't go beyond a document. A null text
    is empty. Rows with a null doc_id stay whole, and nothing goes because of them. Rows that share a doc_id don't take from
    each other. An empty table gives an empty result. Other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    own = rows.filter("doc_id is not null")
    size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(LEAST_PARTS, -(-size // PART_BYTES))
    shards = max(LEAST_PARTS, -(-size // SHARD_BYTES))
    dealt = own.mapInArrow(_deal(parts), "part int, kind int, payload binary").groupBy("part")
    anchor_shards = max(LEAST_PARTS, -(-size // ANCHOR_BYTES))
    repeated = own.mapInArrow(_anchors(parts, anchor_shards), "shard int, payload binary").groupBy("shard").applyInArrow(_repeated, "part int, kind int, payload binary")
    repeated = stage(repeated, "suffix-anchors")
    sent = dealt.cogroup(repeated.groupBy("part")).applyInArrow(_send(shards), "shard int, part int, payload binary")
    answers = sent.groupBy("shard").applyInArrow(_compare, "part int, kind int, payload binary")
    found = dealt.cogroup(repeated.union(answers).groupBy("part")).applyInArrow(_remove(shards), _OUT)
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    loose = rows.filter("doc_id is null").select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), text.alias("kept"), F.array().cast("array<struct<start:bigint,stop:bigint>>").alias("spans"))
    return found.union(loose)

