"""Queries that apply each text operator to its whole table, and the SQL that some are compared with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from plateloom.llm import decontam, language_id, license_scan, line_dedup, lm, packing, simhash, suffix_dedup, topk, warc
from plateloom.llm.common import table


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = {f"_{c}": c for c in ("n_lines", "n_chunks", "removed_chunks", "removed_lines")}
    return out.withColumnsRenamed(counts).select("doc_id", *counts.values(), "text")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language_id.identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return found.select("doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), F.col("_lang").alias("lang_pred"), F.col("_score").alias("score"), F.size("_spans").alias("n_spans"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k_of_table(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", F.col("vec_id") % 100 == 0)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.round_trip(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.dedup_bytes(table(spark, sf_dir, "documents").select("doc_id", "text"))
    gone = F.aggregate("spans", F.lit(0).cast("bigint"), lambda acc, s: acc + s["stop"] - s["start"])
    return found.select("doc_id", "n_bytes", gone.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.drop("detections")


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return decontam.contamination(docs.select("doc_id", "text"), items.select("item_id", "text"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_language_id": op2_language_id,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_exact_topk": op4_exact_topk,
    "op5_warc": op5_warc,
    "op6_lm_scoring": op6_lm_scoring,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_license_scan": op8_license_scan,
    "op9_simhash_near_dedup": op9_simhash_near_dedup,
    "op10_benchmark_decontamination": op10_benchmark_decontamination,
    "pipeline": pipeline,
}

ORACLES = {
    "op4_exact_topk": """
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as double)) as v from embeddings
  where vec_id is not null and embedding is not null
    and list_bool_and(list_transform(embedding, lambda x: x is not null and isfinite(x)))),
scored as (
  select q.vec_id as query_id, c.vec_id, cast(list_dot_product(q.v, c.v) as bigint) as score
  from v q join v c on q.vec_id <> c.vec_id and len(q.v) = len(c.v) where q.vec_id % 100 = 0)
select query_id, cast(rank as int) as rank, vec_id, score
from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from scored) where rank <= 10""",
    "op5_warc": """
with p as (
  select page_id, coalesce(html, '') as html, octet_length(encode(coalesce(html, ''))) as payload_bytes from pages),
d as (
  select *, sha1(html) as payload_digest, max(page_id) over (partition by html) as last from p)
select page_id, payload_bytes, payload_digest,
       case when payload_bytes >= 1000 and page_id <> last then 'revisit' else 'response' end as record_type,
       case when payload_bytes >= 1000 and page_id <> last then last end as refers_to
from d""",
    "op1_line_dedup": r"""
with lines as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 as i
  from documents),
hashed as (
  select *, cast('0x' || substr(md5(line), 1, 7) as bigint) as h, count(*) over (partition by doc_id) as n from lines),
marked as (
  select *, coalesce((h + 8191 * lag(h) over (partition by doc_id order by i)) % 1000003 % 4 <> 0, false) as m from hashed),
near as (
  select doc_id, i, n,
         min(case when m then i end) over (partition by doc_id order by i rows between 1 following and 7 following) as ahead,
         max(case when m then i end) over (partition by doc_id order by i rows between 6 preceding and current row) as back
  from marked),
spans as (
  select doc_id, i as first, coalesce(ahead, least(i + 7, n - 1)) as last from near where i < n - 1
  union
  select doc_id, coalesce(back - 1, greatest(i - 7, 0)), i from near where i > 0),
chunks as (
  select s.doc_id, first, last, string_agg(line, chr(10) order by i) as chunk
  from spans s join lines l on s.doc_id = l.doc_id and l.i between s.first and s.last group by all),
ranked as (select *, row_number() over (partition by chunk order by doc_id, first) > 1 as gone from chunks),
covered as (
  select distinct l.doc_id, l.i from lines l join ranked r on l.doc_id = r.doc_id and l.i between r.first and r.last where r.gone),
counted as (
  select doc_id, count(*) as n_chunks, count(*) filter (gone) as removed_chunks from ranked group by doc_id),
built as (
  select l.doc_id, count(*) as n_lines, count(c.i) as removed_lines,
         string_agg(l.line, chr(10) order by l.i) filter (c.i is null) as kept
  from lines l left join covered c on l.doc_id = c.doc_id and l.i = c.i group by l.doc_id)
select d.doc_id, case when d.text is null then 0 else b.n_lines end as n_lines,
       case when d.text is null then 0 else coalesce(n_chunks, 0) end as n_chunks,
       coalesce(removed_chunks, 0) as removed_chunks, b.removed_lines,
       case when removed_chunks > 0 then coalesce(kept, '') else d.text end as text
from documents d join built b on d.doc_id = b.doc_id left join counted c on d.doc_id = c.doc_id""",
}
