"""A trigram language model in Elias-Fano tries, one for each shard of contexts, trained on and asked by whole corpora."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plateloom.llm import store
from plateloom.llm.common import new_path, stage
from plateloom.llm.language_id import held_out
from plateloom.llm.memory import release, released

#: Text whose n-grams are counted or scored at once, and whose n-grams share a shard, in bytes.
WORK_BYTES = 6 << 20
SHARD_BYTES = 12 << 20
LEAST_SHARDS = 16
#: Weights, in counts, of the next lower order in the probabilities of pairs and of triples of words.
PRIORS = (4.0, 2.0)
#: Probabilities and counts are quantised in so many steps to a power of two.
STEPS = 1024
#: Bits of a context's hash, and of a successor's within its context.
CONTEXT_BITS, SUCCESSOR_BITS = 48, 32
_END, _BEGIN, _AFTER = (xxhash.xxh64_intdigest(x) for x in (b" </s>", b" <s>", b" "))  # no word begins with a blank
_SELECT = np.array([[[b for b in range(8) if x >> b & 1][r] if r < x.bit_count() else 8 for r in range(8)] for x in range(256)], np.uint8)
_COUNT = np.array([x.bit_count() for x in range(256)], np.uint8)


# --- Elias-Fano -------------------------------------------------------------------------------------------------------
class EliasFano:
    """A non-decreasing sequence of at most 2**32 integers in about 3.2 + log2(largest / number) bits each.

    The low bits of the values are packed; their high bits are a unary code (2 bits or so), with a count of the ones
    before each of its 64-bit words (another bit or so). Every query takes and gives arrays.
    """

    def __init__(self, parts: list[np.ndarray]) -> None:
        (self.n, self.width), self.low, self.high = parts[0].tolist(), parts[1], parts[2]
        self.ones = parts[3].astype(np.int64)
        self.zeros = np.arange(len(self.ones), dtype=np.int64) * 64 - self.ones
        self.plain: np.ndarray | None = None
        self.asked = 0

    @staticmethod
    def encode(values: np.ndarray) -> list[np.ndarray]:
        values = values.astype(np.uint64)
        n = len(values)
        width = max(0, int(int(values[-1]) // n).bit_length() - 1) if n else 0
        at = (values >> np.uint64(width)).astype(np.int64) + np.arange(n)
        bits = np.zeros((int(at[-1]) // 64 + 2) * 64 if n else 64, np.uint8)
        bits[at] = 1
        high = np.packbits(bits, bitorder="little").view(np.uint64)
        ones = np.concatenate([[0], np.cumsum(np.bitwise_count(high), dtype=np.int64)])
        low = np.zeros(n * width // 64 + 2, np.uint64)
        if width:
            start = np.arange(n, dtype=np.uint64) * np.uint64(width)
            word, shift = (start >> np.uint64(6)).astype(np.int64), start & np.uint64(63)
            rest = values & np.uint64((1 << width) - 1)
            np.bitwise_or.at(low, word, rest << shift)
            spill = shift + np.uint64(width) > 64
            np.bitwise_or.at(low, word[spill] + 1, rest[spill] >> (np.uint64(64) - shift[spill]))
        return [np.array([n, width], np.int64), low, high, ones.astype(np.uint32)]

    def _select(self, rank: np.ndarray, before: np.ndarray, flip: bool) -> np.ndarray:
        """Where the one (or zero) number ``rank`` stands in the unary code."""
        word = np.searchsorted(before, rank, "right") - 1
        own = self.high[word]
        bytes_ = np.ascontiguousarray(~own if flip else own).view(np.uint8).reshape(-1, 8)
        upto = np.cumsum(_COUNT[bytes_], 1, dtype=np.int64)
        left = rank - before[word]
        byte = (upto <= left[:, None]).sum(1)
        rows = np.arange(len(rank))
        left = left - np.where(byte > 0, upto[rows, byte - 1], 0)
        return word * 64 + byte * 8 + _SELECT[bytes_[rows, byte], left]

    def _lows(self, i: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(i), np.uint64)
        start = i.astype(np.uint64) * np.uint64(self.width)
        word, shift = (start >> np.uint64(6)).astype(np.int64), start & np.uint64(63)
        # shifting by 64 is undefined: the upper word is shifted in two steps
        both = (self.low[word] >> shift) | ((self.low[word + 1] << np.uint64(1)) << (np.uint64(63) - shift))
        return both & np.uint64((1 << self.width) - 1)

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        highs = (self._select(i, self.ones, False) - i).astype(np.uint64)
        return (highs << np.uint64(self.width)) | self._lows(i)

    def decode(self) -> np.ndarray:
        """All values."""
        at = np.flatnonzero(np.unpackbits(self.high.view(np.uint8), bitorder="little"))[: self.n]
        i = np.arange(self.n)
        return ((at - i).astype(np.uint64) << np.uint64(self.width)) | self._lows(i)

    def find(self, values: np.ndarray) -> np.ndarray:
        """The first position of each value; -1 where it doesn't occur.

        Values with the same high bits stand together; from the first of them on, their low bits are searched for the
        successor of what is looked for. Once many values have been asked for, the sequence is decoded.
        """
        out = np.full(len(values), -1, np.int64)
        if not self.n:
            return out
        self.asked += len(values)
        if self.plain is None and self.n < 32 * self.asked:
            self.plain = self.decode()
        if self.plain is not None:
            at = np.minimum(np.searchsorted(self.plain, values), self.n - 1)
            return np.where(self.plain[at] == values, at, -1)
        highs, lows = (values >> np.uint64(self.width)).astype(np.int64), values & np.uint64((1 << self.width) - 1)
        todo = np.flatnonzero(highs < self.zeros[-1])
        h = highs[todo]
        begin = np.zeros(len(todo), np.int64)
        later = h > 0
        begin[later] = self._select(h[later] - 1, self.zeros, True) - (h[later] - 1)
        end = np.minimum(self._select(h, self.zeros, True) - h, self.n)
        live = begin < end
        todo, begin, end = todo[live], begin[live], end[live]
        while len(todo):
            here = self._lows(begin)
            out[todo[here == lows[todo]]] = begin[here == lows[todo]]
            begin = begin + 1
            live = (here < lows[todo]) & (begin < end)
            todo, begin, end = todo[live], begin[live], end[live]
        return out


def pack_arrays(arrays: list[np.ndarray]) -> bytes:
    """Arrays one after the other, each at a multiple of eight bytes, behind a list of their types and sizes."""
    head = np.array([len(arrays), *(x for a in arrays for x in (ord(a.dtype.char), len(a)))], np.int64).tobytes()
    return head + b"".join(a.tobytes() + bytes(-a.nbytes % 8) for a in arrays)


def unpack_arrays(data: np.ndarray) -> list[np.ndarray]:
    """The arrays of ``pack_arrays`` as views of bytes, which may be a mapped file."""
    n = int(data[:8].view(np.int64)[0])
    head = data[8 : 8 + 16 * n].view(np.int64).reshape(n, 2)
    at, out = 8 + 16 * n, []
    for kind, size in head.tolist():
        kind = np.dtype(chr(kind))
        out.append(data[at : at + size * kind.itemsize].view(kind))
        at += -(-size * kind.itemsize // 8) * 8
    return out


# --- n-grams ----------------------------------------------------------------------------------------------------------
class Block(NamedTuple):
    """The tokens of some texts."""

    words: np.ndarray  # hashes of the different tokens, in order
    token: np.ndarray  # of each token its place in ``words``
    owner: np.ndarray  # the text that it is in
    ends: np.ndarray  # of each text

    def digest(self, train: np.ndarray) -> int:
        """A number that depends on all tokens and on which texts are learned from."""
        h = xxhash.xxh64()
        for a in (self.words, self.token, self.ends, np.packbits(train)):
            h.update(np.ascontiguousarray(a).view(np.uint8))
        return int(np.uint64(h.intdigest()).view(np.int64))


def block_of(texts: pa.Array) -> Block:
    """A-Z in lower case, words between ASCII white space, and an end; a null text is empty."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")).cast(pa.large_string()))
    offsets = lists.offsets.to_numpy().astype(np.int64)
    coded = lists.values[offsets[0] : offsets[-1]].dictionary_encode()
    offsets -= offsets[0]
    index, words = coded.indices.to_numpy(), coded.dictionary.cast(pa.large_binary()).to_pylist()
    if b"" in words:  # where a text begins or ends with white space
        keep = index != words.index(b"")
        kept = np.concatenate([[0], np.cumsum(keep)])
        offsets, index = kept[offsets], index[keep]
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    token = np.insert(index.astype(np.int64), offsets[1:], len(words))
    used, token = _renumbered(np.concatenate([hashes, np.array([_END], np.uint64)]), token)
    sizes = np.diff(offsets) + 1
    return Block(used, token, np.repeat(np.arange(len(texts)), sizes), np.cumsum(sizes))


def _renumbered(hashes: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the tokens that occur, in order, and the tokens by these."""
    occurs = np.zeros(len(hashes), bool)
    occurs[token] = True
    some = np.flatnonzero(occurs)
    some = some[np.argsort(hashes[some])]
    rank = np.zeros(len(hashes), np.int64)
    rank[some] = np.arange(len(some))
    return hashes[some], rank[token]


class Grams(NamedTuple):
    """The different contexts (pairs of tokens) of a block in order of their hashes, and the successors of each."""

    context: np.ndarray  # hashes
    sizes: np.ndarray  # different successors
    successor: np.ndarray  # hashes, context by context
    count: np.ndarray  # how often each triple occurs in texts that are learned from
    place: np.ndarray | None  # of each token, the triple that it is the middle of
    owner: np.ndarray | None  # of each token, the context that it ends


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * np.uint64(0x9E3779B97F4A7C15) + (b ^ (b >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def grams_of(block: Block, train: np.ndarray, places: bool = False) -> Grams:
    """Every token with the one before it and the one behind it; beyond a text stand a beginning and what comes after ends."""
    v, n = len(block.words), len(block.token)
    bits = (v + 1).bit_length()
    token = block.token
    before, behind = np.empty(n, np.int64), np.empty(n, np.int64)
    before[1:], behind[:-1] = token[:-1], token[1:]
    if n:
        before[np.r_[0, block.ends[:-1]]] = v
        behind[block.ends - 1] = v + 1
    pair = (before << bits) | token
    if 3 * bits > 62:  # too many different words for a key of three: pairs are numbered first
        pairs, pair = np.unique(pair, return_inverse=True)
    else:
        pairs = None
    key = (((pair << bits) | behind) << 1) | train[block.owner]
    place = None
    if places:
        order = np.argsort(key)
        key = key[order]
    else:
        key.sort()
    new = np.r_[True, key[1:] >> 1 != key[:-1] >> 1] if n else np.zeros(0, bool)
    starts = np.flatnonzero(new)
    count = np.add.reduceat(key & 1, starts) if n else key
    if places:
        place = np.empty(n, np.int64)
        place[order] = np.cumsum(new) - 1
    key = key[starts] >> 1
    pair, successor = key >> bits, key & ((1 << bits) - 1)
    first = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]]) if n else starts
    sizes = np.diff(np.r_[first, len(key)])
    pair = pair[first] if pairs is None else pairs[pair[first]]
    hashes = np.concatenate([block.words, np.array([_BEGIN, _AFTER], np.uint64)])
    context = _mix(hashes[pair >> bits], hashes[pair & ((1 << bits) - 1)])
    order = np.argsort(context)
    moved = sizes[order]
    at = np.r_[0, np.cumsum(moved)[:-1]] if n else moved
    take = np.arange(len(key)) + np.repeat(first[order] - at, moved)
    owner = None
    if places:
        back = np.empty(len(key), np.int64)
        back[take] = np.arange(len(key))
        place = back[place]
        owner = np.repeat(np.arange(len(moved)), moved)[place]
    return Grams(context[order], moved, hashes[successor[take]], count[take], place, owner)


def _parts(batch: pa.RecordBatch, column: str, most: int):
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, to - at)
        at = to


def _edges(hashes: np.ndarray, shards: int) -> np.ndarray:
    """Where the ranges of hashes of the shards begin and end among sorted hashes."""
    return np.r_[0, np.searchsorted(hashes, np.array([-(-(s << 24) // shards) << 40 for s in range(1, shards)], np.uint64)), len(hashes)]


def _small(values: np.ndarray) -> np.ndarray:
    """Non-negative integers in the least type that holds them."""
    return values.astype(np.min_scalar_type(int(values.max(initial=0))))


def _blocks(batches):
    for whole in released(batches):
        for batch in _parts(whole, "text", WORK_BYTES):
            yield batch, block_of(batch.column("text")), batch.column("train").to_numpy(zero_copy_only=False).astype(bool)


def _send(shape: Shape):
    """Each block's different words and triples, packed by shard: words first, then triples."""

    def run(batches):
        for _, block, train in _blocks(batches):
            rows: list[tuple[int, bytes]] = []
            times = np.bincount(block.token, train[block.owner], len(block.words)).astype(np.int64)
            cut = _edges(block.words, shape.words)
            for s in np.flatnonzero(np.diff(cut)).tolist():
                rows.append((s, pack_arrays([block.words[cut[s] : cut[s + 1]], _small(times[cut[s] : cut[s + 1]])])))
            grams = grams_of(block, train)
            cut = _edges(grams.context, shape.grams)
            ends = np.r_[0, np.cumsum(grams.sizes)][cut]
            narrow = grams.context >> np.uint64(64 - CONTEXT_BITS)
            successor = (grams.successor >> np.uint64(64 - SUCCESSOR_BITS)).astype(np.uint32)
            for s in np.flatnonzero(np.diff(cut)).tolist():
                own, triples = slice(cut[s], cut[s + 1]), slice(ends[s], ends[s + 1])
                rows.append((shape.words + s, pack_arrays([narrow[own][:1], _small(np.diff(narrow[own])), _small(grams.sizes[own]), successor[triples], _small(grams.count[triples])])))
            shards, payloads = zip(*rows)
            name = block.digest(train)
            yield pa.RecordBatch.from_arrays([pa.array(shards, pa.int32()), pa.array([name] * len(rows), pa.int64()), pa.array(payloads, pa.binary())], names=["shard", "block", "payload"])

    return run


# --- levels -----------------------------------------------------------------------------------------------------------
class Shape(NamedTuple):
    grams: int  # shards of triples, by context
    words: int  # shards of words


def _sums(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different keys in order, and the sums of the values of each."""
    order = np.argsort(keys)
    keys = keys[order]
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else order
    return keys[starts], np.add.reduceat(values[order], starts) if len(keys) else values


def words_level(hashes: np.ndarray, counts: np.ndarray) -> bytes:
    """The first level: words, and the running sum of their counts."""
    return pack_arrays([*EliasFano.encode(hashes), *EliasFano.encode(np.r_[0, np.cumsum(counts)])])


def _logs(values: np.ndarray) -> np.ndarray:
    return np.minimum(np.rint(np.log2(values) * STEPS) + 1, 65535).astype(np.uint16)


_POWERS = np.r_[0.0, 2.0 ** (np.arange(65535) / STEPS)]
_COUNTS, _SHARES = np.rint(_POWERS), np.r_[0.0, 1 / _POWERS[1:]]


def grams_level(context: np.ndarray, sizes: np.ndarray, successor: np.ndarray, count: np.ndarray) -> bytes:
    """The second and third level: contexts, pointers to their successors, successors, quantised probabilities.

    A triple's probability is its count over that of the context and the weight of the lower order: what a smoothed
    probability has beyond its back-off. Of a context the quantised count is kept, which its back-off and the
    probability of its second word follow from. Successors ascend within a context; with its number above them throughout.
    """
    total = np.add.reduceat(count, np.r_[0, np.cumsum(sizes)[:-1]]) if len(sizes) else count
    number = np.repeat(np.arange(len(sizes), dtype=np.uint64), sizes)
    share = _logs((np.repeat(total, sizes) + PRIORS[1]) / count)
    parts = [*EliasFano.encode(context), *EliasFano.encode(np.r_[0, np.cumsum(sizes)]), *EliasFano.encode((number << np.uint64(SUCCESSOR_BITS)) | successor)]
    coded = [x for values in (_logs(total), share) for x in np.unique(values, return_inverse=True)]
    return pack_arrays([*parts, *(x if x.dtype == np.uint16 else _small(x) for x in coded)])


class WordsLevel:
    def __init__(self, data: np.ndarray) -> None:
        arrays = unpack_arrays(data)
        self.words, self.sums = EliasFano(arrays[0:4]), EliasFano(arrays[4:8])

    def counts(self, hashes: np.ndarray) -> np.ndarray:
        at = self.words.find(hashes)
        out = np.zeros(len(hashes), np.int64)
        hit = at >= 0
        if hit.any():
            out[hit] = (self.sums[at[hit] + 1] - self.sums[at[hit]]).astype(np.int64)
        return out


class GramsLevel:
    def __init__(self, data: np.ndarray) -> None:
        a = unpack_arrays(data)
        self.contexts, self.pointers, self.successors = (EliasFano(a[k : k + 4]) for k in (0, 4, 8))
        self.total, self.share = (a[12], a[13]), (a[14], a[15])

    def ask(self, context: np.ndarray, sizes: np.ndarray, successor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The codes of contexts and of the triples with their successors; 0 where they aren't known.

        A successor is searched for among those of its context, relative to the context's place.
        """
        at = self.contexts.find(context)
        totals, shares = np.zeros(len(context), np.uint16), np.zeros(len(successor), np.uint16)
        totals[at >= 0] = self.total[0][self.total[1][at[at >= 0]]]
        own = np.repeat(at, sizes)
        rows = np.flatnonzero(own >= 0)
        if len(rows):
            found = self.successors.find((own[rows].astype(np.uint64) << np.uint64(SUCCESSOR_BITS)) | successor[rows])
            rows, found = rows[found >= 0], found[found >= 0]
            shares[rows] = self.share[0][self.share[1][found]]
        return totals, shares


_OUT = "kind int, block long, shard int, payload binary, tokens long, known long"
_KINDS = {"kind": pa.int32(), "block": pa.int64(), "shard": pa.int32(), "payload": pa.binary(), "tokens": pa.int64(), "known": pa.int64()}
_ANSWER, _TOTAL = 0, 1


def _level(shape: Shape, learn: bool, folder: str | None, answer: bool):
    """Sums a shard's counts to levels of the trie, or maps these into memory, and answers what each block asks of them."""

    def run(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        asked = [unpack_arrays(np.frombuffer(x.as_py(), np.uint8)) for x in table.column("payload")]
        out: list[tuple] = []
        words = shard < shape.words
        if not words:
            contexts = [np.concatenate([b[0], b[0] + np.cumsum(b[1].astype(np.uint64))]) for b in asked]
        if learn and words:
            hashes, counts = _sums(np.concatenate([b[0] for b in asked]), np.concatenate([b[1].astype(np.int64) for b in asked]))
            some = counts > 0
            data = words_level(hashes[some], counts[some])
            out.append((_TOTAL, shard, shard, None, int(counts.sum()), int(some.sum())))
        elif learn:
            different, number = np.unique(np.concatenate(contexts), return_inverse=True)
            number = np.repeat(number.astype(np.uint64), np.concatenate([b[2].astype(np.int64) for b in asked]))
            key, count = _sums((number << np.uint64(SUCCESSOR_BITS)) | np.concatenate([b[3] for b in asked]), np.concatenate([b[4].astype(np.int64) for b in asked]))
            del number
            key, count = key[count > 0], count[count > 0]
            sizes = np.bincount((key >> np.uint64(SUCCESSOR_BITS)).astype(np.int64), minlength=len(different))
            data = grams_level(different[sizes > 0], sizes[sizes > 0], key & np.uint64((1 << SUCCESSOR_BITS) - 1), count)
            del key, count, different
        if learn and folder:
            store.write(f"{folder}/{shard}", data)
        if answer:
            level = (WordsLevel if words else GramsLevel)(np.frombuffer(data, np.uint8) if learn else store.read(f"{folder}/{shard}"))
            pack = zstandard.ZstdCompressor(level=1).compress
            for k, (name, b) in enumerate(zip(table.column("block").to_pylist(), asked)):
                found = [_small(level.counts(b[0]))] if words else [*level.ask(contexts[k], b[2], b[3])]
                out.append((_ANSWER, name, shard, pack(pack_arrays(found)), 0, 0))
        release()
        columns = zip(*out) if out else [[]] * len(_KINDS)
        return pa.table({k: pa.array(c, kind) for (k, kind), c in zip(_KINDS.items(), columns)})

    return run


def _file(folder: str, block: int) -> str:
    return f"{folder}/{block & 255:02x}/{block & (2**64 - 1):016x}"


def _gather(folder: str):
    """A block's answers, shard after shard, in a file of its own; totals are passed on."""

    def run(table: pa.Table) -> pa.Table:
        if table.column("kind")[0].as_py() == _ANSWER:
            by = dict(zip(table.column("shard").to_pylist(), table.column("payload")))  # equal blocks ask, and get, the same
            parts: list[list[np.ndarray]] = [[], [], []]
            for s in sorted(by):
                found = unpack_arrays(np.frombuffer(zstandard.ZstdDecompressor().decompress(by[s].as_py()), np.uint8))
                for k, x in zip((0,) if len(found) == 1 else (1, 2), found):
                    parts[k].append(x)
            data = pack_arrays([_small(np.concatenate(p)) if p else np.zeros(0, np.uint8) for p in parts])
            store.write(_file(folder, table.column("block")[0].as_py()), zstandard.ZstdCompressor(level=1).compress(data))
        return pa.table({"tokens": [sum(table.column("tokens").to_pylist())], "known": [sum(table.column("known").to_pylist())]})

    return run


class Model(NamedTuple):
    """Where the levels of a model stand, a file for each shard, and the totals that its probabilities need."""

    folder: str
    shape: Shape
    vocabulary: int
    tokens: int


def _texts(docs: DataFrame, train) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), train.alias("train"))


def _shape(texts: DataFrame) -> Shape:
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    grams = max(LEAST_SHARDS, -(-size // SHARD_BYTES))
    return Shape(grams, max(LEAST_SHARDS, grams // 4))


def _answers(texts: DataFrame, shape: Shape, learn: bool, folder: str | None, answer: str | None) -> tuple[int, int]:
    """Runs all shards; tokens and different words that were learned from."""
    rows = texts.mapInArrow(_send(shape), "shard int, block long, payload binary")
    rows = rows.groupBy("shard").applyInArrow(_level(shape, learn, folder, answer is not None), _OUT)
    if answer is not None:
        rows = rows.groupBy("kind", "block").applyInArrow(_gather(answer), "tokens long, known long")
    return tuple(x or 0 for x in stage(rows.select("tokens", "known"), "lm-totals").agg(F.sum("tokens"), F.sum("known")).first())


def train(docs: DataFrame) -> Model:
    """A model of the texts of all rows of ``docs``, in files of the shared folder.

    Blocks of text are counted where they are; their packed counts are dealt by the hash of words or contexts, and every
    shard of words or contexts is summed, coded and written by a task of its own. The driver sees two totals.
    """
    texts = _texts(docs, F.lit(True))
    shape, folder = _shape(texts), new_path(docs.sparkSession, "lm")
    tokens, known = _answers(texts, shape, True, folder, None)
    return Model(folder, shape, known, tokens)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, n_tokens, n_known, base_score, score)`` for each row of ``docs``, over whole texts, by a kept model.

    Blocks send what they ask to the shards, which map their levels into memory; no task reads more than a shard.
    """
    texts, answers = _texts(docs, F.lit(False)), new_path(docs.sparkSession, "lm-answers")
    _answers(texts, model.shape, False, model.folder, answers)
    return _scores(texts, answers, model.tokens, model.vocabulary)


def _scores(texts: DataFrame, answers: str, tokens: int, vocabulary: int) -> DataFrame:
    """Scores from the answers to each block, which a block finds by what it consists of."""

    def run(batches):
        for batch, block, train in _blocks(batches):
            n = batch.num_rows
            grams = grams_of(block, train, places=True)
            found = unpack_arrays(np.frombuffer(zstandard.ZstdDecompressor().decompress(store.read(_file(answers, block.digest(train))).tobytes()), np.uint8))
            count = found[0].astype(np.int64)[block.token]
            base = (count + 1) / (tokens + vocabulary + 1)
            pair = _COUNTS[found[1][grams.owner]]  # how often a token follows the one before it
            share = _SHARES[found[2][grams.place]]
            given = base.copy()
            inner = np.ones(len(count), bool)
            inner[np.r_[0, block.ends[:-1]]] = False
            j = np.flatnonzero(inner)
            second = (pair[j] + PRIORS[0] * base[j]) / (count[j - 1] + PRIORS[0])
            given[j] = share[j - 1] + PRIORS[1] / (pair[j - 1] + PRIORS[1]) * second
            sums = [np.bincount(block.owner, w, n) for w in (np.log10(base), np.log10(given))]
            columns = [np.bincount(block.owner, minlength=n), np.bincount(block.owner, count > 0, n).astype(np.int64), *sums]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, columns)], names=["doc_id", "n_tokens", "n_known", "base_score", "score"])

    return texts.mapInArrow(run, "doc_id long, n_tokens long, n_known long, base_score double, score double")


def score_documents(docs: DataFrame, remainder: int = 2, of: int = 7) -> DataFrame:
    """Scores all rows of ``docs``, learning from those whose crc32(doc_id) mod ``of`` isn't ``remainder``.

    Columns: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``. ``score`` is the log10
    probability of a text: of its first token as a single word, of others given the two before, or one, smoothed by the lower
    orders with the weights ``PRIORS``; no n-gram is left out. Each shard's levels are asked where they are made, so
    that counts and questions are shuffled once. The rows have to come in the same order whenever they are read, as from files.
    Null and empty texts are an end alone. Rows with a null doc_id are learned from. Repeated rows are learned from and
    scored as often as they occur. With nothing to learn from every token is unknown. An empty table gives an empty
    result. Other columns are ignored.
    """
    out = held_out(F.col("doc_id"), remainder, of)
    texts, answers = _texts(docs, ~out), new_path(docs.sparkSession, "lm-answers")
    tokens, known = _answers(texts, _shape(texts), True, None, answers)
    scored = _scores(texts, answers, tokens, known)
    return scored.select("doc_id", out.alias("held_out"), "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")
