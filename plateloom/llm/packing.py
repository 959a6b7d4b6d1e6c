"""Best-fit packing of token sequences into bins of several permitted lengths."""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plateloom.llm.common import stage

#: Permitted sequence lengths, in tokens.
LENGTHS = (256, 512, 1024, 2048, 4096)
#: What a sequence costs besides its length: so many tokens, and this share of its length times its length over the longest.
FIXED_COST = 8.0
ATTENTION_COST = 0.25
#: Pieces that are packed together, on average.
SHARD_PIECES = 4096


def word_count(text: Column) -> Column:
    """The number of tokens if every word is one and a document ends with one more."""
    trimmed = F.btrim(F.coalesce(text.cast("string"), F.lit("")), F.lit(" \t\n\x0b\f\r"))
    return (F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, r"\s+"))) + 1).cast("bigint")


def cost(length: int, longest: int) -> float:
    """The cost of a sequence of ``length``: linear work, attention and a fixed part."""
    return FIXED_COST + length + ATTENTION_COST * length * length / longest


def pack(sizes: np.ndarray, lengths: tuple[int, ...] = LENGTHS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A bin for each piece, its offset in the bin, and the length of each bin.

    Pieces come longest first. A piece goes to the open bin with the least room that holds it. If there is none, a bin is
    opened, of the permitted length at which a token of the pieces still to come is expected to cost least: a bin of
    length L that starts with a piece of n tokens is taken to fill up with what is left, up to L, as far as pieces of at
    most L - n tokens are left. At the end each bin shrinks to the least permitted length that holds its contents.
    """
    lengths = tuple(sorted(lengths))
    longest = lengths[-1]
    order = np.argsort(-sizes, kind="stable")
    small_first = np.sort(sizes)
    volume = np.concatenate([[0], np.cumsum(small_first)])
    costs = [cost(x, longest) for x in lengths]
    rooms: list[int] = []  # the different amounts of room of open bins, ascending
    bins_with: dict[int, list[int]] = {}
    used: list[int] = []
    held, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    left = len(sizes)
    for k in order:
        n, left = int(sizes[k]), left - 1
        at = bisect_left(rooms, n)
        if at < len(rooms):
            room = rooms[at]
            own = bins_with[room].pop()
            if not bins_with[room]:
                del bins_with[room], rooms[at]
        else:
            own, room = len(used), 0
            used.append(0)
            best = float("inf")
            for length, price in zip(lengths, costs):
                if length >= n:
                    # pieces still to come are the ``left`` smallest ones
                    fits = min(left, int(np.searchsorted(small_first, length - n, "right")))
                    share = price / (n + min(length - n, int(volume[fits])))
                    if share < best:
                        best, room = share, length
        held[k], offset[k] = own, used[own]
        used[own] += n
        room -= n
        if room:
            if room not in bins_with:
                bins_with[room] = []
                rooms.insert(bisect_left(rooms, room), room)
            bins_with[room].append(own)
    shrunk = np.array([lengths[bisect_left(lengths, u)] for u in used], np.int64)
    return held, offset, shrunk


def pack_documents(docs: DataFrame, tokens: Column | None = None, lengths: tuple[int, ...] = LENGTHS) -> DataFrame:
    """``(doc_id, piece, start, n_tokens, bin_id, bin_length, bin_offset)``, one row for each piece of each row of ``docs``.

    ``tokens`` is the number of tokens of a document, by default its words and an end. Documents longer than the longest
    permitted length are cut into pieces, none of which is lost: the pieces of a row cover tokens 0 to its number. Pieces
    are dealt by a hash into shards of bounded size, which are packed apart; this costs a partly filled bin or two a
    shard. A null or empty text is one token, the end; rows with no token (where ``tokens`` says so) get no piece. Rows
    with a null doc_id and repeated rows are packed like others. An empty table gives an empty result.
    """
    longest = max(lengths)
    amount = word_count(F.col("text")) if tokens is None else tokens.cast("bigint")
    mark = F.xxhash64(*(F.col(c) for c in ("doc_id", "text") if c in docs.columns))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(amount, F.lit(0)).alias("n"), mark.alias("mark"))
    rows = stage(rows.filter("n > 0"), "packing-sizes")  # texts are read once
    pieces = rows.select("doc_id", "n", "mark", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n") - 1) / longest))).alias("piece"))
    pieces = pieces.select("doc_id", "mark", F.col("piece").cast("int").alias("piece"), (F.col("piece") * longest).alias("start"), F.least(F.lit(longest).cast("bigint"), F.col("n") - F.col("piece") * longest).cast("int").alias("n_tokens"))
    total = rows.agg(F.sum(F.floor((F.col("n") - 1) / longest) + 1)).first()[0] or 0
    shards = max(1, -(-int(total) // SHARD_PIECES))
    pieces = pieces.withColumn("shard", F.pmod(F.xxhash64("mark", "piece"), F.lit(shards)).cast("long")).drop("mark")

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("n_tokens", "descending"), ("doc_id", "ascending"), ("piece", "ascending")])
        held, offset, shrunk = pack(table.column("n_tokens").to_numpy(), lengths)
        shard = table.column("shard")[0].as_py()
        return pa.table(
            {
                **{c: table.column(c) for c in ("doc_id", "piece", "start", "n_tokens")},
                "bin_id": (np.int64(shard) << 24) + held,
                "bin_length": shrunk[held].astype(np.int32),
                "bin_offset": offset.astype(np.int32),
            }
        )

    return pieces.groupBy("shard").applyInArrow(run, "doc_id long, piece int, start long, n_tokens int, bin_id long, bin_length int, bin_offset int")
