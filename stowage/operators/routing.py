"""Rows to planned bins, batches, the permutation shuffle, and the planned reduce."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..config import PACKINGS, ShuffleConfig
from ..plans import packing, padding
from ..sources.tables import local, written
from . import histograms, sampling
from .sorting import ranked


def by_plan(df: DataFrame, plan: DataFrame, bins: int, key: str = "key", row: str | None = None, seed: int = 0, small: bool = False) -> DataFrame:
    """df with `bin`: the plan's, by hash of the key where the plan has none. Given a row id, a split key's rows are dealt
    to its two bins in the planned proportion. small: the plan's size is bounded (see packing.heavy), so it is broadcast,
    and rows are dealt and unplanned keys hashed by cheap hashes, which no other engine needs to know."""
    p = plan.select(key, "w", F.col("bin").alias("__bin"), "first_w", "rest_bin")
    routed = df.join(F.broadcast(p) if small else p, key, "left")
    first = F.col("__bin")
    if row is not None:
        draw = F.xxhash64(F.lit(seed), F.col(row)).bitwiseAND(F.lit((1 << 32) - 1)) if small else sampling.salted(F.col(row), seed, "split")
        stays = draw * F.col("w") < F.col("first_w") * F.lit(1 << 32)
        first = F.when(F.col("rest_bin").isNull() | stays, F.col("__bin")).otherwise(F.col("rest_bin"))
    unseen = F.pmod(F.hash(key), F.lit(bins)) if small else packing.fallback_bin(F.col(key), bins)
    return routed.withColumn("bin", F.coalesce(first, unseen)).drop("w", "__bin", "first_w", "rest_bin")


def by_cutoffs(key: Column, highs: list, bins: list[int]) -> Column:
    """The bin of the first cutoff at or above a key, one past the last bin above all. A binary search, so cost grows with the log of the bins."""
    pairs = sorted(zip(highs, bins))
    if not pairs:
        return F.lit(0)

    def pick(part: list) -> Column:
        if len(part) == 1:
            return F.when(key <= F.lit(part[0][0]), F.lit(part[0][1])).otherwise(F.lit(max(bins) + 1))
        half = len(part) // 2
        return F.when(key <= F.lit(part[half - 1][0]), pick(part[:half])).otherwise(pick(part[half:]))

    return pick(pairs).cast("int")


def place(df: DataFrame, bins: int) -> DataFrame:
    """One partition for each bin, exactly."""
    return df.repartitionById(bins, "bin")


def bin_counts(df: DataFrame, bins: int) -> DataFrame:
    """Rows of every bin, empty ones too."""
    spine = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return spine.join(df.groupBy("bin").agg(F.count("*").alias("cnt")), "bin", "left").select("bin", F.coalesce("cnt", F.lit(0).cast("bigint")).alias("cnt"))


def batched(df: DataFrame, by: list[str], order: list[str], size: int) -> DataFrame:
    """df with `batch_no` in each group of `by`; every row is in one batch, batches have at most `size` rows.

    Groups lie together in one global order, so a large group is numbered by many tasks.
    """
    rows = ranked(df, [*by, *order], "__n")
    first = rows.groupBy(*[F.col(c).alias(f"__{c}") for c in by]).agg(F.min("__n").alias("__first"))
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by])
    return rows.join(first, same).withColumn("batch_no", F.floor((F.col("__n") - F.col("__first")) / size)).drop("__n", "__first", *[f"__{c}" for c in by])


def batches_of(df: DataFrame, order: list[str], config: ShuffleConfig) -> DataFrame:
    """The batches that a configuration asks for: of each bin, or of each bin's real and fake rows apart."""
    by = ["bin"] if config.shuffle_mode == "TaggedBatch" else ["bin", "is_fake"]
    return batched(df, by, order, config.batch_size)


#: Named merges with partial and final forms.
MERGES = {"sum": (F.sum, F.sum), "min": (F.min, F.min), "max": (F.max, F.max), "count": (F.count, F.sum), "set": (F.collect_set, lambda c: F.array_distinct(F.flatten(F.collect_list(c)))), "list": (F.collect_list, lambda c: F.flatten(F.collect_list(c)))}


def two_level(df: DataFrame, key: str, value: str, merge: str, whole: bool = False) -> DataFrame:
    """key and the merged value. First by (bin, key), then by key: a key split over bins is reduced in each and then joined.

    whole: every key has all its rows in one bin, so the first level is the result. A table with `is_fake` keeps its fakes
    up to the first level, where they are merged as nothing; keys that only fakes have go.
    """
    partial, final = MERGES[merge]
    real = F.when(~F.col("is_fake"), F.struct(F.col(value).alias("v"))) if "is_fake" in df.columns else None
    if real is None:
        first = df.groupBy("bin", key).agg(partial(value).alias("part"))
    else:
        first = df.groupBy("bin", key).agg(partial(real["v"]).alias("part"), F.count(real).alias("__real")).where("__real > 0").drop("__real")
    if whole:
        return first.select(key, F.col("part").alias("value"))
    return first.groupBy(key).agg(final("part").alias("value"))


def padded(df: DataFrame, loads: list[tuple[int, int]], samples: DataFrame) -> DataFrame:
    """df (with `bin`), flagged false, with as many flagged copies of a bin's sampled row as the loads (bin, fakes) say."""
    plan = local(df.sparkSession, [x for x in loads if x[1] > 0], StructType().add("bin", "integer").add("fake_cnt", "long"))
    fakes = padding.repeated(F.broadcast(plan), F.broadcast(samples))  # a row a bin each
    return df.withColumn("is_fake", F.lit(False)).unionByName(fakes.select(*df.columns, "is_fake"))


def planned_reduce(df: DataFrame, key: str, value: str, row: str, config: ShuffleConfig, merge: str = "sum") -> DataFrame:
    """key and the merged value, over planned bins: sample, histogram of heavy keys, plan, routing, padding, exchange, reduce.

    Heavy keys are the only ones that need a plan, and their number is bounded, so they are planned on the driver; all
    others go by hash. An associative merge splits heavy keys; otherwise bins are padded with flagged rows, which are
    exchanged like the others and merged as nothing. The input is read for the sample, for the loads (if bins are padded)
    and for the exchange.
    """
    bins, seed = config.bins, config.global_seed
    rows = df.select(F.col(key).alias("key"), F.col(value).alias("value"), F.col(row).alias("row"))
    hashed = config.histogram == "HashedCount"
    plan_key = "plan_key" if hashed else "key"
    if hashed:
        rows = rows.withColumn("plan_key", histograms.key_of(F.col("key"), config.histogram))
    draw = F.xxhash64(F.lit("sample"), F.lit(seed), "row").bitwiseAND(F.lit((1 << 32) - 1))
    sample = rows.where(draw < int(config.alpha * (1 << 32))) if config.alpha < 1 else rows
    heavy = packing.heavy_rows(histograms.counting(sample.where(F.col(plan_key).isNotNull()), plan_key), bins, key=plan_key)
    rule, order = ("split_sequential", "ordering") if config.is_associative else (PACKINGS[config.balanced_shuffle], config.balanced_shuffle_order)
    try:
        planned = packing.plan_rows(heavy, bins, rule, order)
    except packing.BinsExhausted:  # keys larger than their share of the bins
        planned = packing.plan_rows(heavy, bins, "split_lightest" if config.is_associative else "greedy", order)
    shape = StructType().add(plan_key, rows.schema[plan_key].dataType).add("w", "long").add("bin", "integer").add("first_w", "long").add("rest_bin", "integer")
    plan = local(df.sparkSession, planned, shape)
    split = config.is_associative or any(r[4] is not None for r in planned)
    routed = by_plan(rows, plan, bins, plan_key, "row" if split else None, seed, small=True).select("bin", "key", "value", "row")
    if not config.is_associative:
        each = routed.groupBy("bin").agg(F.count("*").alias("cnt"), F.min(F.struct("key", "value")).alias("r")).collect()  # a row a bin
        found = {r["bin"]: r["cnt"] for r in each}
        target, sampler = config.c * sum(found.values()) / bins, sampling.Binomial(seed, config.binomial_mode)
        fakes = [(b, sampler.draw(padding.ideal_count(found[b], target, bins, 1.0, config.beta), 1.0 / bins)) for b in sorted(found)]
        routed = routed.select("bin", "key", "value")
        samples = local(df.sparkSession, [(r["bin"], r["r"]["key"], r["r"]["value"]) for r in each], routed.schema)
        routed = padded(routed, fakes, samples)
    out = two_level(place(routed, bins), "key", "value", merge, whole=not split)
    return out.select(F.col("key").alias(key), "value")


def permuted(df: DataFrame, row: str, config: ShuffleConfig, factor: float) -> DataFrame:
    """df with `tag` and `position` (from 1) in a random order: rows get a tag and a random bin, bins are padded, exchanged
    and written, and only then are fakes dropped and rows numbered by (tag, row)."""
    tagged = sampling.prebin(df.withColumn("tag", sampling.salted(F.col(row), config.global_seed, "tag")), row, config.bins, config.global_seed, config.random_shuffle)
    sent = written(place(padding.by_factor(tagged, "bin", factor), config.bins), "permuted")
    return ranked(padding.drop_fakes(sent).drop("bin"), ["tag", row], "position")


def mismatches(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """How many keys differ between two results; a missing key differs."""
    x, y = a.select(F.col(key).alias("k"), F.col(value).alias("x"), F.lit(1).alias("in_x")), b.select(F.col(key).alias("k2"), F.col(value).alias("y"), F.lit(1).alias("in_y"))
    same = F.col("in_x").eqNullSafe(F.col("in_y")) & F.col("x").eqNullSafe(F.col("y"))
    return x.join(y, F.col("k").eqNullSafe(F.col("k2")), "full_outer").agg(F.count_if(~same).alias("mismatches"), F.count("*").alias("keys"))
