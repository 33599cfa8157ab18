"""Batch jobs over lines, pairs and edges."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from ..functions import text as T
from ..sources.tables import adjacency, id_and_rest, tab_pairs, text_lines, written
from .sorting import range_sort


def counts(tokens: Column, df: DataFrame, name: str = "word") -> DataFrame:
    """Occurrences of each token of an array column."""
    return df.select(F.explode(tokens).alias(name)).groupBy(name).agg(F.count("*").alias("cnt"))


def median_by_key(df: DataFrame, key: str, value: str) -> DataFrame:
    """The exact median of each key, the mean of the two middle values for an even number.

    A first aggregation counts equal values, so a key with very many rows costs a row for each of its different values.
    """
    return df.groupBy(key, value).agg(F.count("*").alias("n")).groupBy(key).agg(F.percentile(value, 0.5, F.col("n")).alias("median"))


def count_median(tokens: Column, df: DataFrame) -> DataFrame:
    """Occurrences of each token and the median of its attached values, which are ones."""
    ones = df.select(F.explode(tokens).alias("word"), F.lit(1.0).alias("one")).groupBy("word", "one").agg(F.count("*").alias("n"))
    return ones.groupBy("word").agg(F.sum("n").alias("cnt"), F.percentile("one", 0.5, F.col("n")).alias("median"))


def inverted_index(docs: DataFrame, doc: str, tokens: Column, separator: str = ",") -> DataFrame:
    """Each word with the sorted ids (as text) of the documents that hold it.

    Pairs move once, to their word, and nothing is grouped before that; whole numbers become text behind the exchange. A
    document that has several rows counts once, by the set of ids.
    """
    whole = isinstance(docs.schema[doc].dataType, IntegralType)
    pairs = docs.select((F.col(doc) if whole else F.col(doc).cast("string")).alias("d"), F.explode(F.array_distinct(tokens)).alias("word"))
    ids = pairs.repartition("word").groupBy("word").agg(F.collect_set("d").alias("ids"))
    return ids.select("word", F.array_join(F.array_sort(F.col("ids").cast("array<string>")), separator).alias("docs"))


def inverted_index_tf(docs: DataFrame, doc: str, tokens: Column) -> DataFrame:
    """How often each word occurs in each document."""
    return docs.select(doc, F.explode(tokens).alias("word")).groupBy("word", doc).agg(F.count("*").alias("cnt"))


def pagerank(edges: DataFrame, iterations: int, damping: float = 0.85, src: str = "src", dst: str = "dst", cut_every: int = 5) -> DataFrame:
    """id and rank after a fixed number of iterations from rank 1: (1 - damping) + damping * sum(rank / out-degree).

    A page without in-links has no rank after the first iteration; what dangling pages hold is lost. Equal edges count
    once. The plan is cut every few iterations, so it doesn't grow with them.
    """
    links = edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")).distinct()
    degree = links.groupBy("src").agg(F.count("*").alias("deg"))
    links = written(links.join(degree, "src"), "links")
    ranks = degree.select(F.col("src").alias("id"), F.lit(1.0).alias("rank"))
    for i in range(1, iterations + 1):
        sent = links.join(ranks, links.src == ranks.id).select(F.col("dst").alias("id"), (F.col("rank") / F.col("deg")).alias("part"))
        ranks = sent.groupBy("id").agg((F.lit(1 - damping) + F.lit(damping) * F.sum("part")).alias("rank"))
        if i % cut_every == 0 and i < iterations:
            ranks = written(ranks, "ranks")
    return ranks


def edges_of(lines: DataFrame, line: str = "line") -> DataFrame:
    """Edges of adjacency lines; repeated lines of a page are merged."""
    page, neighbours = adjacency(F.col(line))
    return lines.select(page.alias("src"), F.explode(neighbours).alias("dst")).distinct()


def _hist(lines: DataFrame) -> DataFrame:
    return counts(T.words_space(F.col("line")), lines)


def _median(lines: DataFrame) -> DataFrame:
    k, v = tab_pairs(F.col("line"))
    return median_by_key(lines.select(k.alias("key"), v.alias("value")), "key", "value")


def _index(lines: DataFrame) -> DataFrame:
    d, t = id_and_rest(F.col("line"))
    return inverted_index(lines.select(d.alias("doc"), t.alias("text")), "doc", T.words_space(F.col("text")))


JOBS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "hist": lambda x: _hist(x).select(F.concat_ws("\t", "word", F.col("cnt").cast("string")).alias("value")),
    "median": lambda x: _median(x).select(F.concat_ws("\t", "key", F.col("median").cast("string")).alias("value")),
    "terasort": lambda x: range_sort(x).orderBy("row_no").select(F.concat("prefix", "rest").alias("value")),
    "invertedindex": lambda x: _index(x).select(F.concat_ws("\t", "word", "docs").alias("value")),
    "hist_median": lambda x: count_median(T.words_space(F.col("line")), x).select(F.format_string("%s\tcount=%d\tmedian=%s", "word", "cnt", F.col("median").cast("string")).alias("value")),
    "pagerank": lambda x: pagerank(edges_of(x), 10).select(F.concat_ws("\t", "id", F.col("rank").cast("string")).alias("value")),
}


def run(spark: SparkSession, source: str, job: str, target: str) -> None:
    """A named job from text lines to text lines."""
    if job.lower() not in JOBS:
        raise ValueError(f"unknown job {job!r}; known: {', '.join(JOBS)}")
    JOBS[job.lower()](text_lines(spark, source)).write.text(target)
