"""Language identification: scripts narrow the candidates, Viterbi labels the spans of mixed texts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plateloom.llm.memory import released

#: Labelled documents that the model learns from, on average; all of them where there are fewer.
TRAINING_DOCS = 8_000
#: Character n-grams of words with their ends marked, counted in so many cells.
ORDERS = (1, 2, 3, 4)
CELLS = 1 << 15
SMOOTHING = 0.5
#: What a change of language between two words costs, in natural logarithms.
SWITCH = 8.0
#: A language is a candidate for a script that holds at least this share of the letters it was learned from.
SCRIPT_SHARE = 0.002
UNKNOWN = "und"
#: Text in a batch of work; the rest of an Arrow batch follows in further ones.
WORK_BYTES = 12 << 20
#: Different words whose n-grams are laid out at once.
WORK_WORDS = 1 << 15

#: The first code points of ranges and the script that starts there; 0 is no particular one.
SCRIPTS = (
    (0x0, 0), (0x41, 1), (0x250, 0), (0x370, 2), (0x400, 3), (0x530, 4), (0x590, 5), (0x600, 6), (0x700, 0),
    (0x750, 6), (0x780, 0), (0x900, 7), (0x980, 8), (0xA00, 9), (0xA80, 10), (0xB00, 11), (0xB80, 12), (0xC00, 13),
    (0xC80, 14), (0xD00, 15), (0xD80, 16), (0xE00, 17), (0xE80, 18), (0xF00, 19), (0x1000, 20), (0x10A0, 21),
    (0x1100, 22), (0x1200, 23), (0x1380, 0), (0x1780, 24), (0x1800, 0), (0x1E00, 1), (0x1F00, 2), (0x2000, 0),
    (0x3040, 25), (0x30A0, 26), (0x3100, 0), (0x3400, 27), (0xA000, 0), (0xAC00, 22), (0xD7B0, 0), (0xF900, 27),
    (0xFB00, 0), (0xFF66, 26), (0xFFA0, 0), (0x20000, 27), (0x31350, 0),
)
_STARTS = np.array([s for s, _ in SCRIPTS], np.uint32)
_SCRIPT = np.array([k for _, k in SCRIPTS], np.uint8)
N_SCRIPTS = 28


class Words:
    """The words of a batch of texts: runs of letters in lower case, each different one once."""

    def __init__(self, texts: pa.Array) -> None:
        plain = pc.utf8_lower(pc.replace_substring_regex(pc.fill_null(texts, ""), r"[^\p{L}\p{M}]+", " "))
        lists = pc.split_pattern(plain.cast(pa.large_string()), " ")
        self.offsets = lists.offsets.to_numpy().astype(np.int64)
        coded = lists.values[self.offsets[0] : self.offsets[-1]].dictionary_encode()
        self.offsets -= self.offsets[0]
        index, self.words = coded.indices.to_numpy(), coded.dictionary.to_pylist()
        if "" in self.words:  # at the ends of texts
            keep = index != self.words.index("")
            kept = np.concatenate([[0], np.cumsum(keep)])
            self.offsets, index = kept[self.offsets], index[keep]
        self.index = index

    def grams(self, at: int, to: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cells of all n-grams of some of the different words, the word of each (from 0), and each word's script."""
        words = self.words[at:to]
        flat = np.frombuffer("".join(f"\x02{w}\x03" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
        owner = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        cells, owners = [], []
        mixed = np.zeros(len(flat), np.uint64)
        for n in range(1, max(ORDERS) + 1):
            mixed = (mixed[: len(flat) - n + 1] * np.uint64(0x9E3779B97F4A7C15)) ^ (flat[n - 1 :].astype(np.uint64) + np.uint64(n << 40))
            if n in ORDERS:
                whole = owner[: len(mixed)] == owner[n - 1 :]
                cells.append((((mixed * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(40)) % np.uint64(CELLS))[whole].astype(np.int32))
                owners.append(owner[: len(mixed)][whole])
        first = np.concatenate([[0], np.cumsum(sizes)[:-1]]) + 1
        script = _SCRIPT[np.searchsorted(_STARTS, flat[np.minimum(first, max(len(flat) - 1, 0))], "right") - 1] if len(flat) else np.zeros(0, np.uint8)
        return np.concatenate(cells), np.concatenate(owners), script


def _parts(batch: pa.RecordBatch, column: str):
    """Slices of a batch with about WORK_BYTES of text each."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        begun = sizes[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(sizes, begun + WORK_BYTES, "right")))
        yield batch.slice(at, to - at)
        at = to


def held_out(doc_id, remainder: int = 2, of: int = 4):
    """Whether a document is kept from the training; null ids aren't held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(of)) == remainder, F.lit(False))


class Model:
    """Per-language log probabilities of n-gram cells and the scripts of each language."""

    def __init__(self, langs: list[str], counts: np.ndarray, scripts: np.ndarray) -> None:
        self.langs = langs
        shares = (counts + SMOOTHING) / (counts.sum(0) + SMOOTHING * CELLS) if langs else counts
        self.table = np.log(shares).astype(np.float32)
        allowed = scripts >= SCRIPT_SHARE * np.maximum(scripts.sum(0), 1)
        self.allowed = np.where(allowed | ~allowed.any(1, keepdims=True), 0, -1e4).astype(np.float32)
        self.known = allowed.any(1)

    def scores(self, words: Words) -> np.ndarray:
        """Log likelihoods, words by languages; words of a script that no language has say nothing."""
        out = np.zeros((len(words.words), len(self.langs)), np.float32)
        for at in range(0, len(out), WORK_WORDS):
            part = out[at : at + WORK_WORDS]
            cells, owner, script = words.grams(at, at + WORK_WORDS)
            for k in range(len(self.langs)):
                part[:, k] = np.bincount(owner, self.table[cells, k], len(part))
            part += self.allowed[script]
            part -= part.max(1, keepdims=True)
            part[~self.known[script]] = 0
        return out


def train(docs: DataFrame) -> Model:
    """Learns from ``text`` and ``lang`` of the rows of ``docs`` that have both and aren't held out.

    About TRAINING_DOCS of these rows are used, chosen by a hash of doc_id; they are counted where they are, and only the
    summed cells of each language reach the driver.
    """
    rows = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.filter("doc_id is not null and text is not null and lang is not null").filter(~held_out(F.col("doc_id")))
    total = docs.filter("lang is not null").select("doc_id").filter(~held_out(F.col("doc_id"))).count()
    if total > TRAINING_DOCS:
        rows = rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < (1 << 30) * TRAINING_DOCS // total)

    def count(batches):
        for whole in released(batches):
            for batch in _parts(whole, "text"):
                words = Words(batch.column("text"))
                langs = batch.column("lang").dictionary_encode()
                if not words.words:
                    continue
                of_word = np.repeat(langs.indices.to_numpy(), np.diff(words.offsets))
                totals = np.zeros((len(langs.dictionary), CELLS + N_SCRIPTS))
                times = [np.bincount(words.index[of_word == k], minlength=len(words.words)) for k in range(len(totals))]
                for at in range(0, len(words.words), WORK_WORDS):
                    cells, owner, script = words.grams(at, at + WORK_WORDS)
                    for own, n in zip(totals, times):
                        own[:CELLS] += np.bincount(cells, n[at : at + WORK_WORDS][owner], CELLS)
                        own[CELLS:] += np.bincount(script, n[at : at + WORK_WORDS], N_SCRIPTS)
                for k, lang in enumerate(langs.dictionary.to_pylist()):
                    found = totals[k].astype(np.int64)
                    some = np.flatnonzero(found)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some)), pa.array(some.astype(np.int32)), pa.array(found[some])], names=["lang", "cell", "n"])

    summed = rows.select("text", "lang").mapInArrow(count, "lang string, cell int, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(summed.column("lang").to_pylist()))
    counts = np.zeros((CELLS + N_SCRIPTS, len(langs)))
    if langs:
        at = np.searchsorted(np.array(langs), np.array(summed.column("lang").to_pylist()))
        counts[summed.column("cell").to_numpy(), at] = summed.column("n").to_numpy()
    return Model(langs, counts[:CELLS], counts[CELLS:])


def viterbi(scores: np.ndarray, index: np.ndarray, offsets: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best language of each word: of all labellings, that with the most summed score less ``switch`` a change.

    All texts of a batch take a step at once; those that have ended drop out.
    """
    sizes = np.diff(offsets)
    order = np.argsort(-sizes, kind="stable")
    starts, sizes = offsets[:-1][order], sizes[order]
    alive = np.searchsorted(-sizes, -np.arange(int(sizes[0]) if len(sizes) else 0), "left")
    label = np.min_scalar_type(max(scores.shape[1] - 1, 0))
    back, labels = [], np.zeros(len(index), label)
    best, last = None, np.zeros(len(order), np.int64)
    rows = np.arange(len(order))
    for t, n in enumerate(alive):
        here = scores[index[starts[:n] + t]]
        if t:
            ended = best[n:]
            if len(ended):
                last[n : n + len(ended)] = ended.argmax(1)
            best = best[:n]
            top = best.argmax(1)
            moved = (best[rows[:n], top] - switch)[:, None]
            stay = best >= moved
            back.append(np.where(stay, np.arange(scores.shape[1], dtype=label), top[:, None].astype(label)))
            here = np.where(stay, best, moved) + here
        best = here
    if best is not None:
        last[: len(best)] = best.argmax(1)
    for t in range(len(alive) - 1, -1, -1):
        n = alive[t]
        labels[starts[:n] + t] = last[:n]
        if t:
            last[:n] = back[t - 1][rows[:n], last[:n]]
    return labels


def identify(docs: DataFrame, model: Model | None = None, switch: float = SWITCH) -> DataFrame:
    """All columns of ``docs`` and, in place of any of the same name, ``_lang``, ``_score`` and ``_spans``.

    ``_spans`` lists the runs of words of one language as (first word, word after the last, language); ``_lang`` is the
    language of most words, first in order on ties, and ``_score`` its share of the words. A text that is null or has no
    letter gets ``und``, score 0 and no span, and so does everything if there is no labelled document to learn from. An
    empty table gives an empty result; repeated rows give repeated results.
    """
    model = model or train(docs)
    spans = T.ArrayType(T.StructType([T.StructField("first", T.IntegerType()), T.StructField("stop", T.IntegerType()), T.StructField("lang", T.StringType())]))
    added = [T.StructField("_lang", T.StringType()), T.StructField("_score", T.DoubleType()), T.StructField("_spans", spans)]
    rows = docs.drop(*(f.name for f in added))
    schema = T.StructType([*rows.schema.fields, *added])
    n_langs, kind = len(model.langs), pa.list_(pa.struct([("first", pa.int32()), ("stop", pa.int32()), ("lang", pa.string())]))

    def label(batch: pa.RecordBatch) -> list[pa.Array]:
        n = batch.num_rows
        words = Words(batch.column("text").cast(pa.string()))
        offsets = words.offsets
        if not n_langs:
            return [pa.array([UNKNOWN] * n), pa.array(np.zeros(n)), pa.array([[]] * n, kind)]
        labels = viterbi(model.scores(words), words.index, offsets, switch)
        owner = np.repeat(np.arange(n), np.diff(offsets))
        votes = np.bincount(owner * n_langs + labels.astype(np.int64), minlength=n * n_langs).reshape(n, n_langs)
        top, total = votes.argmax(1), votes.sum(1)
        named = pa.array([model.langs[k] if m else UNKNOWN for k, m in zip(top, total)], pa.string())
        begins = np.flatnonzero(np.r_[True, (labels[1:] != labels[:-1]) | (owner[1:] != owner[:-1])]) if len(labels) else np.zeros(0, np.int64)
        ends = np.r_[begins[1:], len(labels)] if len(labels) else begins
        base = offsets[owner[begins]]
        flat = pa.StructArray.from_arrays([pa.array((begins - base).astype(np.int32)), pa.array((ends - base).astype(np.int32)), pa.array(np.array(model.langs, object)[labels[begins]], pa.string())], fields=list(kind.value_type))
        lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(owner[begins], np.arange(n + 1)).astype(np.int32)), flat)
        return [named, pa.array(votes[np.arange(n), top] / np.maximum(total, 1)), lists]

    def run(batches):
        for whole in released(batches):
            for batch in _parts(whole, "text"):
                yield pa.RecordBatch.from_arrays([*batch.columns, *label(batch)], names=schema.names)

    return rows.mapInArrow(run, schema)


def keep_identified(docs: DataFrame, least_score: float = 0.0) -> DataFrame:
    """The rows of ``docs`` with words of a language, in however many languages.

    With ``least_score``, those whose language of most words has less than this share of them go too.
    """
    found = identify(docs)
    return found.filter((F.col("_lang") != UNKNOWN) & (F.col("_score") >= least_score)).select(*(F.col(f"`{c}`") for c in docs.columns))
