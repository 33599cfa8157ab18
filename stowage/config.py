"""Settings of the planned shuffle, read from Spark's configuration."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import SparkSession

HISTOGRAMS = ("DirectCount", "HashedCount")
ORDERS = ("ordering", "hashcode")
STRATEGIES = ("PRG", "Hierarchical")
BATCHES = ("TaggedBatch", "FlaggedBatch")
#: Names of packings and the rules that they stand for.
PACKINGS = {"SimpleGreedyBinPacking": "greedy", "greedy": "greedy", "next_fit": "next_fit", "split_lightest": "split_lightest", "split_sequential": "split_sequential"}
BINOMIALS = ("exact", "normal", "fast", "library")
PREFIX = "spark.stowage."


@dataclass(frozen=True)
class ShuffleConfig:
    """alpha: sampling rate; beta: padding slack; c: target load as a multiple of the mean; random_shuffle: how rows get random
    bins; histogram: whether keys or their hashes are counted; balanced_shuffle and its order: the packing of keys that aren't
    split; shuffle_mode and batch_size: how bins are cut into batches; delta is accepted and unused."""

    c: int = 1
    alpha: float = 0.01
    delta: float = 0.05
    beta: float = 0.1
    random_shuffle: str = "PRG"
    histogram: str = "DirectCount"
    balanced_shuffle: str = "SimpleGreedyBinPacking"
    balanced_shuffle_order: str = "hashcode"
    fake_padding: str = "RepeatReal"
    shuffle_mode: str = "TaggedBatch"
    global_seed: int = 1337
    batch_size: int = 100
    bins: int = 64
    binomial_mode: str = "exact"

    def __post_init__(self) -> None:
        for value, allowed in ((self.histogram, HISTOGRAMS), (self.balanced_shuffle_order, ORDERS), (self.binomial_mode, BINOMIALS), (self.random_shuffle, STRATEGIES), (self.shuffle_mode, BATCHES), (self.balanced_shuffle, PACKINGS)):
            if value not in allowed:
                raise ValueError(f"unknown value {value!r}; known: {', '.join(allowed)}")
        if self.bins < 1 or self.batch_size < 1:
            raise ValueError("bins and batch size must be positive")

    @property
    def is_associative(self) -> bool:
        return self.fake_padding.lower() == "associative"

    @classmethod
    def from_spark(cls, spark: SparkSession, prefix: str = PREFIX) -> ShuffleConfig:
        """Each field from its camel-case key under `prefix`, else its default."""
        found = {}
        for f in fields(cls):
            head, *rest = f.name.split("_")
            raw = spark.conf.get(prefix + head + "".join(x.title() for x in rest), None)
            if raw is not None:
                kind = type(f.default)
                found[f.name] = raw.lower() == "true" if kind is bool else kind(raw)
        return cls(**found)
