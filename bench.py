"""Runs the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line.

Each planned query is timed beside the plain Spark form of the same result (`plain_...`); a value is the median of three
runs after one warm-up, all rows produced (written to a sink that drops them).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stowage import catalog
from stowage.sources.tables import table

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))
QUERIES = "word_count word_count_ws inverted_index_tf key_sum key_sum_split median_by_key pagerank range_sort sort_ranked column_sort permuted_reduce padded_reduce greedy_bins".split()


def _words(spark: SparkSession, d: str, cut: str, lower: bool) -> DataFrame:
    text = F.lower("text") if lower else F.col("text")
    return table(spark, d, "documents").select("doc_id", F.explode(F.split(text, cut)).alias("word"))


def plain_count(spark: SparkSession, d: str) -> DataFrame:
    return _words(spark, d, r"\W+", True).where("word <> ''").groupBy("word").count()


def plain_count_ws(spark: SparkSession, d: str) -> DataFrame:
    return _words(spark, d, r"\s+", False).groupBy("word").count()


def plain_index(spark: SparkSession, d: str) -> DataFrame:
    return _words(spark, d, r"\W+", True).where("word <> ''").groupBy("word", "doc_id").count()


def plain_split_sum(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type").agg(F.sum("user_id").alias("value"))


def plain_median(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.median("l_quantity").alias("median"))


def plain_line_sort(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.explode(F.split("text", "\n")).alias("line")).orderBy("line")


def plain_sum(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.sum(F.col("l_quantity").cast("bigint")).alias("value"))


def plain_sort(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_custkey", "o_orderkey").orderBy("o_custkey", "o_orderkey")


#: Each query's twin: the plain Spark form of the same result. Only pagerank and greedy_bins have none.
TWINS = {
    "word_count": plain_count, "word_count_ws": plain_count_ws, "inverted_index_tf": plain_index, "key_sum": plain_sum, "padded_reduce": plain_sum, "key_sum_split": plain_split_sum,
    "permuted_reduce": plain_split_sum, "median_by_key": plain_median, "range_sort": plain_line_sort, "sort_ranked": plain_sort, "column_sort": plain_sort,
}


def timed(f, spark: SparkSession) -> float:
    def once() -> float:
        t = time.perf_counter()
        f(spark, SF).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - t

    once()
    return round(statistics.median(once() for _ in range(RUNS)), 3)


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("bench").config("spark.sql.shuffle.partitions", CPUS).config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    todo = {name: catalog.QUERIES[name] for name in QUERIES} | {f.__name__: f for f in TWINS.values()}
    if len(sys.argv) > 1:
        todo = {k: v for k, v in todo.items() if k in sys.argv[1:]}
    seconds = {name: timed(f, spark) for name, f in todo.items()}
    ratios = {n: round(seconds[n] / seconds[p], 2) for n, p in ((n, f.__name__) for n, f in TWINS.items()) if n in seconds and p in seconds}
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "ratio_to_plain": ratios, "sf": SF.rstrip("/").rsplit("sf", 1)[-1], "cpus": CPUS}))
    spark.stop()


if __name__ == "__main__":
    main()
