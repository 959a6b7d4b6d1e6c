"""Line dedup with DataFrame functions only: content-defined chunks of lines, removed where they repeat."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plateloom.llm.common import stage

#: Multipliers of the rolling hash, newest line first, and its modulus; one of DIVISOR places is no boundary on average.
MULTIPLIERS = (1, 8191)
MODULUS = 1_000_003
DIVISOR = 4
#: Lines of the longest chunk.
MOST = 8
#: (doc_id, line) as one number that aggregates cheaply.
PLACE = "decimal(38,0)"
LINES = 10**12


def line_hash(line: Column) -> Column:
    """A hash below 2**28, from the first seven digits of the line's MD5."""
    return F.conv(F.substring(F.md5(line), 1, 7), 16, 10).cast("bigint")


def boundaries(hashes: Column) -> Column:
    """For each line whether a boundary is behind it: the rolling hash of it and the line before it says so."""
    def marked(h: Column, i: Column) -> Column:
        rolled = sum(m * F.get(hashes, i - j) for j, m in enumerate(MULTIPLIERS))
        return F.coalesce(F.pmod(F.pmod(rolled, F.lit(MODULUS)), F.lit(DIVISOR)) != 0, F.lit(False))

    return F.transform(hashes, marked)


def chunk_codes(marks: Column) -> Column:
    """The chunks of lines, as ``first * 16 + lines``, from where the boundaries are.

    From every line a chunk reaches to the next boundary that makes it two lines or more, and to every line one from
    the latest place where two lines with a boundary behind them begin; at most MOST lines, and not beyond the text.
    What a chunk is depends on its own lines alone: lines put in or taken out elsewhere change nothing, and a repeated
    passage with one boundary or more inside is covered from its first line to its last.
    """
    n = F.size(marks)

    def ahead(i: Column) -> Column:
        cap = F.least(i + (MOST - 1), n - 1)
        return reduce(lambda rest, k: F.when(F.coalesce(F.get(marks, i + k), F.lit(True)) | (cap <= i + k), F.lit(k)).otherwise(rest), range(MOST - 2, 0, -1), F.lit(MOST - 1))

    def back(i: Column) -> Column:
        return reduce(lambda rest, k: F.when(F.coalesce(F.get(marks, i - k + 1), F.lit(True)) | (i <= k), F.lit(k)).otherwise(rest), range(MOST - 2, 0, -1), F.lit(MOST - 1))

    forward = F.transform(F.sequence(F.lit(0), n - 2), lambda i: i * 16 + ahead(i) + 1)
    backward = F.transform(F.sequence(F.lit(1), n - 1), lambda i: (i - back(i)) * 16 + back(i) + 1)
    return F.when(n > 1, F.array_union(forward, backward)).otherwise(F.array().cast("array<int>"))


def _first(code: Column) -> Column:
    return F.shiftright(code, 4)


def _size(code: Column) -> Column:
    return code.bitwiseAND(F.lit(15))


def _split(docs: DataFrame) -> DataFrame:
    return docs.withColumn("_lines", F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), "\n", -1))


def _coded(split: DataFrame) -> DataFrame:
    # every array that a lambda looks into is a column of its own, or it would be worked out for each element
    split = split.withColumn("_hashes", F.transform("_lines", line_hash)).withColumn("_marks", boundaries(F.col("_hashes")))
    return split.withColumn("_codes", chunk_codes(F.col("_marks")))


def _identity(line: Column) -> Column:
    return F.xxhash64(line)


def _ambiguous(work: DataFrame) -> bool:
    """Whether two different lines have one hash: every different line is compared by its bytes."""
    lines = work.select(F.explode("_lines").alias("line"))
    different = lines.select(_identity(F.col("line")).alias("h"), "line").distinct()
    return different.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").head() is not None


def dedup_lines(docs: DataFrame) -> DataFrame:
    """All columns of ``docs`` with repeats taken out of ``text``, and what was taken out.

    Lines end at line feeds. Of all chunks with the same bytes the one in the document of smallest doc_id, and in it the first,
    stays; the lines of the others go. Chunks overlap and are judged on the input, so that of every line one copy is
    left. New columns, in place of any of the same name: ``_n_lines``, ``_n_chunks``, ``_removed_chunks`` and
    ``_removed_lines`` (long). A null text stays null and has no line; an empty text has one line. Rows with a null
    doc_id stay as they are, and nothing counts as a repeat of them. Repeated rows with one doc_id are one document: what
    goes from one goes from all. An empty table gives an empty result.

    Bytes are compared line by line over the whole corpus: if no two different lines have one hash, chunks are told
    apart by the hashes of their lines; else by their whole text.
    """
    ids = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").cast("long").alias("id"))
    work = _split(ids.select(F.col("id").alias("doc_id"), F.col("row.text").alias("text")).filter("doc_id is not null"))
    rows = _coded(work).withColumn("_ids", F.transform("_lines", _identity))
    first, size = _first(F.col("code")), _size(F.col("code"))
    exact = F.array_join(F.slice("_lines", first + 1, size), "\n") if _ambiguous(work) else F.lit(None).cast("string")
    # explode() would bring a filter on the size of the array, which is then worked out twice
    rows = rows.select("doc_id", "_lines", "_ids", F.explode_outer("_codes").alias("code")).filter("code is not null")
    key = F.slice("_ids", first + 1, size)
    chunks = stage(rows.select("doc_id", "code", key.alias("key"), F.coalesce(exact, F.lit("")).alias("exact")), "line-chunks")
    keys = ["key", "exact"]
    place = (F.col("doc_id").cast(PLACE) * F.lit(LINES).cast("decimal(13,0)") + _first(F.col("code"))).cast(PLACE)
    kept = chunks.groupBy(*keys).agg(F.min(place).alias("kept"), F.count(F.lit(1)).alias("times")).filter("times > 1").drop("times")
    # the keys grow with the input, so they are never broadcast
    gone = chunks.join(kept.hint("merge"), keys).filter(place > F.col("kept")).groupBy(F.col("doc_id").alias("gone_id")).agg(F.collect_set("code").alias("gone"))
    rows = ids.join(gone, F.col("id") == F.col("gone_id"), "left")
    rows = rows.select("row", F.col("row.text").alias("text"), F.coalesce("gone", F.array().cast("array<int>")).alias("gone"))
    rows = _coded(_split(rows))
    covered = F.array_distinct(F.flatten(F.transform("gone", lambda c: F.sequence(_first(c), _first(c) + _size(c) - 1))))
    rows = rows.withColumn("_covered", covered)
    stay = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_covered"))
    text = F.array_join(F.transform(stay, lambda i: F.get("_lines", i)), "\n")
    has = F.col("text").isNotNull()
    added = {
        "_n_lines": F.when(has, F.size("_lines")).otherwise(0).cast("bigint"),
        "_n_chunks": F.when(has, F.size("_codes")).otherwise(0).cast("bigint"),
        "_removed_chunks": F.size("gone").cast("bigint"),
        "_removed_lines": F.size("_covered").cast("bigint"),
    }
    text = F.when(F.size("gone") > 0, text).otherwise(F.col("text"))
    own = [(text if c == "text" else F.col(f"row.`{c}`")).alias(c) for c in docs.columns if c not in added]
    return rows.select(*own, *(x.alias(c) for c, x in added.items()))


def without_repeats(docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` with repeats taken out of ``text``; ``n_chars``, if there, follows."""
    out = dedup_lines(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(*(F.col(f"`{c}`") for c in docs.columns))
