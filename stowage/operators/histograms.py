"""Key histograms over samples, and their merges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import java_hash


def key_of(key: Column, mode: str = "DirectCount") -> Column:
    """The key itself, or its hash as text."""
    if mode == "DirectCount":
        return key
    if mode == "HashedCount":
        return java_hash(key.cast("string")).cast("string")
    raise ValueError(f"unknown histogram mode {mode!r}")


def counting(df: DataFrame, key: str) -> DataFrame:
    """key and w, the number of its rows."""
    return df.groupBy(key).agg(F.count("*").alias("w"))


def capped(df: DataFrame, part: str, key: str) -> DataFrame:
    """For each part and key: w is 1, however often the key occurs; `overflow` counts the repeats."""
    return df.groupBy(part, key).agg(F.lit(1).cast("bigint").alias("w"), (F.count("*") - 1).alias("overflow"))


def merged(histograms: list[DataFrame], key: str, counts: tuple[str, ...] = ("w",)) -> DataFrame:
    """The key-wise sum; the order of the histograms doesn't matter."""
    union = reduce(DataFrame.unionByName, histograms)
    return union.groupBy(key).agg(*[F.sum(c).alias(c) for c in counts])


def centralized(local: DataFrame, remotes: list[DataFrame], key: str) -> DataFrame:
    return merged([local, *remotes], key)


def decentralized(local: DataFrame, remotes: list[DataFrame], key: str) -> DataFrame:
    return merged([*remotes, local], key)


MERGES = {"centralized": centralized, "decentralized": decentralized}


def merge(strategy: str, local: DataFrame, remotes: list[DataFrame], key: str) -> DataFrame:
    """The merge of a named strategy; both give the same histogram."""
    if strategy not in MERGES:
        raise ValueError(f"unknown merge {strategy!r}; known: {', '.join(MERGES)}")
    return MERGES[strategy](local, remotes, key)


def save(histogram: DataFrame, path: str) -> None:
    """A snapshot of a histogram as a table; a snapshot that is there is replaced."""
    histogram.write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def cleared(histogram: DataFrame) -> DataFrame:
    """The empty histogram of the same kind."""
    return histogram.where(F.lit(False))


def full(df: DataFrame, key: str, value: str) -> DataFrame:
    """The sum of a value for each key."""
    return df.groupBy(key).agg(F.sum(value).alias("w"))
