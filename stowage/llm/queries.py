"""The registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import packing, quality_lines, tokens
from .common import table
from .html import op3_html_differencing
from .media import op1_media_copies
from .near_dedup import op4_near_dedup_omh
from .nbsvm import op9_quality_nbsvm
from .piece_sampling import op10_piece_sampling
from .quality_lines import op7_quality_lines
from .sharding import op5_sharding_splitters
from .toxicity import op8_toxicity_crf


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every document."""
    return tokens.count_tokens(table(spark, sf_dir, "documents"), carry=["doc_id"])


def op6_packing_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each piece of every document."""
    return packing.digest(packing.pack(table(spark, sf_dir, "documents")))


def base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op7 that SQL can express: the base counts and rules of every document."""
    docs = table(spark, sf_dir, "documents")
    return quality_lines.label(docs, quality_lines.fit([]), ["doc_id"]).drop("kept", "content_share")


def text_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op2 and op5 that SQL can express: the bytes of every document, counted by either."""
    counted = op2_token_counts(spark, sf_dir).select("doc_id", "n_bytes")
    return counted.join(op5_sharding_splitters(spark, sf_dir).select("doc_id", "size"), "doc_id")


def shard_law(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The law of op5: each shard's slots are gapless, and its bytes differ from an eighth of all by one record at most."""
    rows = op5_sharding_splitters(spark, sf_dir)
    each = rows.groupBy("shard").agg(F.count("*").alias("n"), F.sum("size").alias("b"), F.max("slot").alias("last"), F.countDistinct("slot").alias("slots"))
    total, most = rows.agg(F.sum("size"), F.max("size")).first()
    return each.select("shard", ((F.col("last") == F.col("n") - 1) & (F.col("slots") == F.col("n"))).alias("gapless"), (F.abs(F.col("b") - total / 8) <= most).alias("even"))


QUERIES = {
    "op1_media_copies": op1_media_copies,
    "op2_token_counts": op2_token_counts,
    "op3_html_differencing": op3_html_differencing,
    "op4_near_dedup_omh": op4_near_dedup_omh,
    "op5_sharding_splitters": op5_sharding_splitters,
    "op6_packing_binary": op6_packing_binary,
    "op7_quality_lines": op7_quality_lines,
    "op8_toxicity_crf": op8_toxicity_crf,
    "op9_quality_nbsvm": op9_quality_nbsvm,
    "op10_piece_sampling": op10_piece_sampling,
    "base_counts": base_counts,
    "text_sizes": text_sizes,
    "shard_law": shard_law,
}
_WORD = r"[^\x20\x09-\x0D]+"
ORACLES: dict[str, str] = {
    "base_counts": rf"""
with d as (select doc_id, coalesce(text, '') as text from documents),
w as (select doc_id, unnest(ws) as word, unnest(range(len(ws))) as i from (select doc_id, regexp_extract_all(text, '{_WORD}') as ws from d)),
t as (select doc_id, i, [word, lead(word, 1) over s, lead(word, 2) over s] as trio, lead(i, 2) over s as last from w window s as (partition by doc_id order by i)),
r as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, trio) as n from t where last is not null) where n > 1),
p as (select doc_id, count(distinct i + k)::bigint as n_repeat_words from r, (select unnest(range(3)) as k) group by doc_id),
l as (select doc_id, (count(*) - count(distinct line))::bigint as n_dup_lines from (select doc_id, unnest(string_split(text, chr(10))) as line from d) where regexp_matches(line, '{_WORD}') group by doc_id),
c as (select doc_id, count(*)::bigint as n_words, sum(length(word))::bigint as word_chars from w group by doc_id)
select d.doc_id, coalesce(n_words, 0) as n_words, coalesce(word_chars, 0) as word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
coalesce(n_dup_lines, 0) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words, coalesce(n_words, 0) < 50 or 100 * coalesce(n_repeat_words, 0) > 50 * coalesce(n_words, 0) as base_failed
from d left join c using (doc_id) left join p using (doc_id) left join l using (doc_id)""",
    "text_sizes": "select doc_id, strlen(coalesce(text, ''))::bigint as n_bytes, (strlen(coalesce(text, '')) + 1)::bigint as size from documents",
    "shard_law": "select unnest(range(8))::int as shard, true as gapless, true as even",
}
