"""Plans that put histogram keys into bins.

Each rule is sequential by definition, so the ordered histogram streams through one task that holds a load for each bin
and nothing else; the histogram has a row for each key, not for each record. Plans are tables:
key, w, bin, first_w (the part of w that stays in bin; all of it unless the key is split) and rest_bin.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.text import java_hash, java_hash_of

Rule = Callable[[int], tuple[int, int, int | None]]


class BinsExhausted(RuntimeError):
    """A rule ran out of bins."""


def least_loaded(bins: int, total: int) -> Rule:
    heap = [(0, b) for b in range(bins)]

    def place(w: int) -> tuple[int, int, int | None]:
        load, b = heap[0]
        heapq.heapreplace(heap, (load + w, b))
        return b, w, None

    return place


def next_fit(bins: int, total: int) -> Rule:
    capacity = -(-2 * total // (bins + 1))  # ceil(total / bins * 2 bins / (bins + 1))
    now = load = 0

    def place(w: int) -> tuple[int, int, int | None]:
        nonlocal now, load
        if load + w > capacity:
            now, load = now + 1, 0
            if now >= bins:
                raise BinsExhausted("more bins are needed")
        load += w
        return now, w, None

    return place


def split_lightest(bins: int, total: int) -> Rule:
    """An overflowing key leaves in the lightest bin what fits under the mean; the rest goes to the next bin."""
    loads = [0] * bins

    def place(w: int) -> tuple[int, int, int | None]:
        b = loads.index(min(loads))
        room = max(0, (total - bins * loads[b]) // bins)
        if bins * (loads[b] + w) <= total:
            loads[b] += w
            return b, w, None
        first, other = min(w, room), min(b + 1, bins - 1)
        loads[b] += first
        loads[other] += w - first
        return b, first, other

    return place


def split_sequential(bins: int, total: int) -> Rule:
    """Bins are filled one after the other; a key that overflows is split over two neighbours."""
    capacity = -(-total // bins)
    now = load = 0

    def place(w: int) -> tuple[int, int, int | None]:
        nonlocal now, load
        while load >= capacity > 0:
            now, load = now + 1, 0
        if now >= bins:
            raise BinsExhausted("capacity is used up before the last key")
        room = capacity - load
        if w <= room:
            load += w
            return now, w, None
        if now + 1 >= bins:
            raise BinsExhausted("a key needs a bin more")
        before, now, load = now, now + 1, w - room
        return before, room, now

    # an over-full second bin counts as full, like any other
    return place


#: Keys that a sequential rule takes at most; more is an error, not a cut.
MOST_KEYS = 20_000_000
RULES = {"greedy": least_loaded, "next_fit": next_fit, "split_lightest": split_lightest, "split_sequential": split_sequential}


def plan(histogram: DataFrame, bins: int, rule: str = "greedy", order: str = "ordering", key: str = "key", w: str = "w", most: int = MOST_KEYS) -> DataFrame:
    """The plan of a histogram of at most `most` keys; keys in their own order or in that of their hash (ties by key)."""
    if order not in ("ordering", "hashcode"):
        raise ValueError(f"unknown order {order!r}")
    if bins < 1:
        raise ValueError("at least one bin is needed")
    total, n = histogram.agg(F.coalesce(F.sum(w), F.lit(0)).cast("bigint"), F.count("*")).first()
    if n > most:
        raise ValueError(f"a plan takes its keys one by one: {n} are more than {most}; plan the heavy keys and send the others by hash (heavy, routing.planned_reduce)")
    make = RULES[rule]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = make(bins, total)
        for batch in batches:
            put = [place(x) for x in batch.column(1).to_pylist()]
            b, first, rest = ([p[i] for p in put] for i in range(3))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(b, pa.int32()), pa.array(first, pa.int64()), pa.array(rest, pa.int32())], names=[key, "w", "bin", "first_w", "rest_bin"])

    rank = [F.col(key)] if order == "ordering" else [java_hash(F.col(key).cast("string")), F.col(key)]
    ordered = histogram.select(key, F.col(w).cast("bigint").alias("w")).repartition(1).sortWithinPartitions(*rank)
    return ordered.mapInArrow(each, f"`{key}` {histogram.schema[key].dataType.simpleString()}, w long, bin int, first_w long, rest_bin int")


def plan_rows(rows: list[tuple], bins: int, rule: str, order: str, total: int | None = None) -> list[tuple]:
    """The same for a bounded list of (key, w) on the driver: (key, w, bin, first_w, rest_bin)."""
    rank = (lambda r: r[0]) if order == "ordering" else (lambda r: (java_hash_of(str(r[0])), r[0]))
    place = RULES[rule](bins, sum(w for _, w in rows) if total is None else total)
    return [(k, w, *place(w)) for k, w in sorted(rows, key=rank)]


def heavy_rows(histogram: DataFrame, bins: int, share: int = 100, key: str = "key", w: str = "w") -> list[tuple]:
    """What heavy() keeps, as a list: at most share * bins rows reach the driver. The histogram is read once."""
    seen = Observation()
    top = histogram.select(key, w).observe(seen, F.sum(w).alias("total")).orderBy(F.col(w).desc(), key).limit(share * bins).collect()
    total = (seen.get["total"] or 0) if top else 0
    return [(r[0], r[1]) for r in top if r[1] * share * bins >= total]


def cutoffs(planned: DataFrame, key: str = "key") -> DataFrame:
    """The highest key first placed in each bin; bins keep their numbers, empty bins have no row."""
    return planned.groupBy("bin").agg(F.max(key).alias("hi_key"))


def loads(planned: DataFrame, bins: int) -> DataFrame:
    """The planned load of every bin, empty ones too."""
    parts = planned.select("bin", F.col("first_w").alias("x")).unionByName(planned.where("rest_bin is not null").select(F.col("rest_bin").alias("bin"), (F.col("w") - F.col("first_w")).alias("x")))
    spine = planned.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return spine.join(parts.groupBy("bin").agg(F.sum("x").alias("load")), "bin", "left").select("bin", F.coalesce("load", F.lit(0).cast("bigint")).alias("load"))


def fallback_bin(key: Column, bins: int) -> Column:
    """The bin of a key that the plan doesn't know."""
    return F.pmod(java_hash(key.cast("string")), F.lit(bins)).cast("int")


def heavy(histogram: DataFrame, bins: int, share: int = 100, w: str = "w") -> DataFrame:
    """Keys with at least total / (share * bins) rows: never more than share * bins keys, so a plan of them may be broadcast."""
    total = histogram.agg(F.coalesce(F.sum(w), F.lit(0))).first()[0]
    return histogram.where(F.col(w) * (share * bins) >= F.lit(int(total)))
