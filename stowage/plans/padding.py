"""Plans of fake rows that hide bin sizes, and the rows themselves. A padded table always has `is_fake`.

What a bin's load is decides alpha: 1 for counts of all rows, the sampling rate for counts of a sample.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.sampling import Binomial, times


def ideal(real: Column, target: Column, bins: int, alpha: float, beta: float) -> Column:
    """Fakes a bin should get before any draw: floor of max(0, (1 + beta) * ((2 n - 1) / n * target - real / alpha))."""
    bound = F.lit((2.0 * bins - 1) / bins) * target - real.cast("double") / F.lit(alpha)
    return F.floor(F.greatest(F.lit(0.0), F.lit(1 + beta) * bound)).cast("bigint")


def ideal_count(real: int, target: float, bins: int, alpha: float, beta: float) -> int:
    """The same for a load that the driver knows."""
    return int(max(0.0, (1 + beta) * ((2.0 * bins - 1) / bins * target - real / alpha)))


def mean_load(loads: DataFrame, column: str = "cnt") -> float:
    return float(loads.agg(F.coalesce(F.avg(column), F.lit(0.0))).first()[0])


def planned(loads: DataFrame, bins: int, alpha: float, beta: float, target: float | None = None, column: str = "cnt") -> DataFrame:
    """bin, cnt and `fake_cnt`, the undrawn plan."""
    d = F.lit(mean_load(loads, column) if target is None else target)
    return loads.withColumn("fake_cnt", ideal(F.col(column), d, bins, alpha, beta))


def drawn(loads: DataFrame, bins: int, alpha: float, beta: float, seed: int, mode: str = "exact", target: float | None = None) -> DataFrame:
    """bin and fake_cnt, each a binomial draw of the plan with chance 1 / bins. One row for each bin, so the driver draws."""
    rows = planned(loads, bins, alpha, beta, target).select("bin", "fake_cnt").orderBy("bin").collect()
    if len(rows) != bins:
        raise ValueError(f"{len(rows)} loads for {bins} bins")
    sampler = Binomial(seed, mode)
    return loads.sparkSession.createDataFrame([(r["bin"], sampler.draw(r["fake_cnt"], 1.0 / bins)) for r in rows], "bin int, fake_cnt long")


def drawn_matrix(loads: DataFrame, bins: int, alpha: float, beta: float, seed: int, mode: str = "exact", target: float | None = None) -> DataFrame:
    """(src_bin, dst_bin, fake_cnt): every planned fake of a bin goes to some bin; a row's sum is the plan."""
    rows = planned(loads, bins, alpha, beta, target).select("bin", "fake_cnt").orderBy("bin").collect()
    if len(rows) != bins:
        raise ValueError(f"{len(rows)} loads for {bins} bins")
    sampler, out = Binomial(seed, mode), []
    for r in rows:
        left = r["fake_cnt"]
        for j in range(bins):
            n = sampler.draw(left, 1.0 / (bins - j))
            left -= n
            out.append((r["bin"], j, n))
    return loads.sparkSession.createDataFrame(out, "src_bin int, dst_bin int, fake_cnt long")


def _numbered(plan: DataFrame) -> DataFrame:
    return times(plan.select("bin", "fake_cnt"), F.col("fake_cnt"), "i").select("bin", F.col("i") + 1).toDF("bin", "i")


def synthetic(plan: DataFrame) -> DataFrame:
    """Flagged rows with made-up keys."""
    return _numbered(plan).select("bin", F.format_string("fake-%d-%d", "bin", "i").alias("key"), F.lit(-1).cast("bigint").alias("value"), F.lit(True).alias("is_fake"))


def repeated(plan: DataFrame, samples: DataFrame) -> DataFrame:
    """Flagged copies of one sampled real row of each bin (samples: a row a bin)."""
    return _numbered(plan).join(samples, "bin").drop("i").withColumn("is_fake", F.lit(True))


def by_factor(df: DataFrame, group: str, factor: float) -> DataFrame:
    """df, flagged false, with null rows that bring each group to ceil(factor * size)."""
    real = df.withColumn("is_fake", F.lit(False))
    need = df.groupBy(group).agg((F.ceil(F.lit(float(factor)) * F.count("*")) - F.count("*")).cast("bigint").alias("n")).where("n > 0")
    fakes = times(need, F.col("n")).select(group, F.lit(True).alias("is_fake"))
    return real.unionByName(fakes, allowMissingColumns=True)


def rectangular(df: DataFrame, rows: int) -> DataFrame:
    """df, flagged false, filled with null rows up to a number of rows."""
    missing = max(0, rows - df.count())
    pad = df.sparkSession.range(missing).select(F.lit(True).alias("is_fake"))
    return df.withColumn("is_fake", F.lit(False)).unionByName(pad, allowMissingColumns=True)


PLANS = {"RepeatReal": repeated, "Synthetic": synthetic}


def drop_fakes(df: DataFrame) -> DataFrame:
    """The real rows. A filter moves below exchanges, so fakes that must be exchanged are written first or merged as nothing (routing.two_level)."""
    return df.where(~F.col("is_fake")).drop("is_fake")
