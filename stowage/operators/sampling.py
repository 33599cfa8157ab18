"""Random bins, samples, scaling and binomial draws. Draws that a result depends on are hashes of row and seed."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import BINOMIALS
from ..functions.text import hash_u32


def salted(row: Column, seed: int, use: str) -> Column:
    """A uniform 32-bit number for a row, a seed and a use."""
    return hash_u32(F.concat_ws(":", F.lit(use), F.lit(str(seed)), row.cast("string")))


def generated(spark: SparkSession, rows: int, keys: int, seed: int) -> DataFrame:
    """Made-up rows for trials: id (from 0), a key drawn from `keys`, and a value from 0 to 999. The same for every seed on any cluster."""
    key, value = salted(F.col("id"), seed, "key") % keys, salted(F.col("id"), seed, "value") % 1000
    return spark.range(rows).select("id", F.format_string("key-%d", key).alias("key"), value.alias("value"))


def uniform_bin(row: Column, bins: int, seed: int) -> Column:
    return (salted(row, seed, "bin") % bins).cast("int")


def hierarchical_bin(row: Column, bins: int, seed: int) -> Column:
    """A coin picks the lower or the upper half of the bins, a second draw the bin inside; one bin or fewer: 0."""
    if bins <= 1:
        return F.lit(0)
    half, draw = bins // 2, salted(row, seed, "inner")
    return F.when(salted(row, seed, "coin") % 2 == 0, draw % half).otherwise(F.lit(half) + draw % (bins - half)).cast("int")


STRATEGIES = {"PRG": uniform_bin, "Hierarchical": hierarchical_bin}


def prebin(df: DataFrame, row: str, bins: int, seed: int, strategy: str = "PRG") -> DataFrame:
    """df with a random `bin`."""
    return df.withColumn("bin", STRATEGIES[strategy](F.col(row), bins, seed))


def bernoulli(df: DataFrame, row: Column, alpha: float, seed: int) -> DataFrame:
    """Rows kept with probability alpha, by a hash of the row."""
    return df.where(salted(row, seed, "sample") < int(alpha * (1 << 32)))


def scaled(df: DataFrame, scale: float, part: Column, row: Column, seed: int) -> DataFrame:
    """Within each logical part: below 1 a random floor(scale n) of the rows; above 1 every row floor(scale) times and a random floor(fraction n) once more."""
    from .sorting import ranked  # which needs this module

    whole, fraction = int(scale), scale - int(scale)
    if scale < 0:
        raise ValueError("scale must not be negative")
    if not fraction:
        return times(df, F.lit(whole)) if whole > 1 else df if whole else df.limit(0)
    # a part's rows are neighbours in the global order, so a row's number in its part is its rank less the part's first
    rows = ranked(df.withColumns({"__part": part, "__draw": salted(row, seed, "scale"), "__row": row}), ["__part", "__draw", "__row"], "__i")
    parts = rows.groupBy(F.col("__part").alias("__of")).agg(F.count("*").alias("__n"), F.min("__i").alias("__first"))
    numbered = rows.join(parts, F.col("__part").eqNullSafe(F.col("__of")))
    more = (F.col("__i") - F.col("__first") < F.floor(F.lit(fraction) * F.col("__n"))).cast("int")
    return times(numbered, F.lit(whole) + more).drop("__part", "__draw", "__row", "__of", "__n", "__first", "__i")


def times(df: DataFrame, n: Column, number: str | None = None, block: int = 1 << 16) -> DataFrame:
    """Each row n times, with the copy's number (from 0) if it has a name. Large numbers are cut into blocks that are dealt to all tasks."""
    size = df.withColumn("__times", n.cast("bigint")).where("__times > 0")
    blocks = size.withColumn("__block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("__times") - 1) / block))))
    blocks = blocks.repartition(F.xxhash64("__block", *[F.col(f"`{c}`") for c in df.columns]))
    first = F.col("__block") * block
    out = blocks.withColumn(number or "__copy", F.explode(F.sequence(first, F.least(first + block, F.col("__times")) - 1)))
    return out.drop("__times", "__block", *([] if number else ["__copy"]))


#: Most coins that a draw flips one by one.
FLIPS = 1 << 16


class Binomial:
    """Draws from Binomial(n, p): exact (n coin flips, beyond FLIPS the library's draw, which has the same distribution),
    normal or fast (a rounded, clamped Gaussian), library."""

    def __init__(self, seed: int, mode: str = "exact"):
        if mode not in BINOMIALS:
            raise ValueError(f"unknown mode {mode!r}")
        self.rng, self.mode = np.random.default_rng(seed), mode

    def draw(self, n: int, p: float) -> int:
        if n <= 0 or p <= 0:
            return 0
        if p >= 1:
            return n
        if self.mode == "exact" and n <= FLIPS:
            return int((self.rng.random(n) < p).sum())
        if self.mode in ("exact", "library"):
            return int(self.rng.binomial(n, p))
        return int(min(n, max(0, round(self.rng.normal(n * p, (n * p * (1 - p)) ** 0.5)))))


def binomial_by_hash(df: DataFrame, group: str, n: str, p: float, seed: int) -> DataFrame:
    """group and `successes` among its n hashed coin flips."""
    flips = times(df.select(group, n), F.col(n), "i")
    hit = salted(F.concat_ws("/", F.col(group).cast("string"), (F.col("i") + 1).cast("string")), seed, "flip") < int(p * (1 << 32))
    return flips.groupBy(group).agg(F.count_if(hit).alias("successes"))


def first_rows(df: DataFrame, part: str, order: list[str]) -> DataFrame:
    """The first row of each non-empty part, by a partial and a final minimum."""
    rest = [c for c in df.columns if c not in (part, *order)]
    return df.groupBy(part).agg(F.min(F.struct(*order, *rest)).alias("r")).select(part, "r.*")
