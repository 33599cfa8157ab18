"""Sharding by sampled splitters.

Records are ordered by (hash of the text, hash of the row), so equal texts lie together and a shard's border may still
fall inside a large group of copies. Keys are sampled with a weight that grows with a record's size; quantiles of the
sample are the splitters of many fine ranges; ranges that turn out overfull are subdivided by samples of their own, and
so are the few in which a shard has to end, down to single records. Shards begin and end at splitters: a shard is a run
of ranges, and a range's counted rows and bytes say which.

Only splitters and a count and size for each range reach the driver, about MOST_RANGES of them; beyond
MOST_RANGES * RANGE_ROWS records a range holds so many more, and one task sorts a range.

Laws: `bytes` (shards' sizes differ by about one record) and `rows` (counts at most one apart).

Defined cases: a null text has size 1, the crc of an empty text; a null id is a key like any other; repeated rows are
placed each; very long texts count with their whole size, and one larger than a shard leaves its neighbours short or
empty; an empty table gives an empty table; input columns besides id and text are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import mapped, table, text_of, written

SHARDS = 8
#: Fine ranges: about so many rows each, and so many ranges at most.
RANGE_ROWS = 128
MOST_RANGES = 1 << 16
#: Sampled keys for each range.
OVERSAMPLE = 8
#: Times the mean weight from which a range is overfull, and rounds of subdivision.
OVERFULL = 2.5
ROUNDS = 3


def _places(h: np.ndarray, t: np.ndarray, sh: np.ndarray, st: np.ndarray) -> np.ndarray:
    """How many splitters (sh, st), sorted, are at or below each key (h, t)."""
    low, high = np.searchsorted(sh, h, "left"), np.searchsorted(sh, h, "right")
    out = low.copy()
    tied = np.flatnonzero(high > low)
    for start in np.unique(low[tied]).tolist():
        mine = tied[low[tied] == start]
        out[mine] += np.searchsorted(st[start : high[mine[0]]], t[mine], "right")
    return out


def ranged(keys: DataFrame, splitters: np.ndarray) -> DataFrame:
    """keys with the number of the range that each row falls in."""
    sent = keys.sparkSession.sparkContext.broadcast((splitters[:, 0].copy(), splitters[:, 1].copy()))  # about MOST_RANGES pairs, 1 MB

    def each(batch: pa.RecordBatch):
        h, t = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("h", "t"))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(_places(h, t, *sent.value), pa.int64())], names=[*batch.schema.names, "range"])

    return mapped(keys, each, "doc_id long, size long, text_crc32 long, h long, t long, range long")


def _sampled(keys: DataFrame, rate_bytes: float, rate_rows: float) -> np.ndarray:
    """Keys drawn with probability (several times where it exceeds 1) size * rate_bytes + rate_rows, by a hash of the row."""
    u = (F.xxhash64(F.col("t"), F.lit(17)).bitwiseAND(F.lit((1 << 30) - 1))) / F.lit(float(1 << 30))
    times = F.floor(F.col("size") * F.lit(rate_bytes) + F.lit(rate_rows) + u).cast("long")
    drawn = keys.select("h", "t", times.alias("k")).where("k > 0").toPandas()
    out = np.repeat(drawn[["h", "t"]].to_numpy(np.int64), drawn.k.to_numpy(), axis=0)
    return out[np.lexsort((out[:, 1], out[:, 0]))]


def _quantiles(sample: np.ndarray, ranges: int) -> np.ndarray:
    at = (np.arange(1, ranges) * len(sample)) // ranges
    return np.unique(sample[at], axis=0) if len(sample) else sample


def splitters(keys: DataFrame, rows: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Splitters of the fine ranges, and of each range its number, rows and bytes."""
    ranges = int(min(MOST_RANGES, max(1, rows // RANGE_ROWS)))
    want = ranges * OVERSAMPLE
    cuts = _quantiles(_sampled(keys, want / 2 / max(1, size), want / 2 / max(1, rows)), ranges)
    for turn in range(ROUNDS + 1):
        weighed = ranged(keys, cuts).groupBy("range").agg(F.count("*").alias("n"), F.sum("size").alias("b")).toPandas().sort_values("range")
        share = (weighed.n / max(1, rows) + weighed.b / max(1, size)) / 2
        over = weighed.range[(share * ranges > OVERFULL) & (weighed.n > 1)].to_numpy()
        if turn == ROUNDS or not len(over):
            return cuts, weighed[["range", "n", "b"]].to_numpy(np.int64)
        inside = ranged(keys, cuts).where(F.col("range").isin(over.tolist()))
        more = _sampled(inside, want / size * 2, want / rows * 2)
        where = _places(more[:, 0], more[:, 1], cuts[:, 0], cuts[:, 1])
        new = [cuts]
        for r in over.tolist():
            mine = more[where == r]
            parts = int(np.ceil(float(share[weighed.range == r].iloc[0]) * ranges))
            new.append(_quantiles(mine, max(2, parts)))
        cuts = np.unique(np.concatenate(new), axis=0)
    raise AssertionError


def _shard_of(weighed: np.ndarray, shards: int, law: str) -> np.ndarray:
    """The shard of each range (number, rows, bytes), by where its middle lies."""
    n, b = (np.cumsum(weighed[:, k]) - weighed[:, k] for k in (1, 2))
    if law == "bytes":
        return np.minimum((b * 2 + weighed[:, 2]) * shards // max(1, 2 * int(weighed[:, 2].sum())), shards - 1)
    return n * shards // max(1, int(weighed[:, 1].sum()))


def _cut(weighed: np.ndarray, shards: int, law: str) -> np.ndarray:
    """The numbers of the ranges with two rows or more in which a shard ends."""
    k = 2 if law == "bytes" else 1
    total, start = int(weighed[:, k].sum()), np.cumsum(weighed[:, k]) - weighed[:, k]
    first, last = start * shards // max(1, total), (start + np.maximum(weighed[:, k], 1) - 1) * shards // max(1, total)
    return weighed[(first != last) & (weighed[:, 1] > 1), 0]


def borders(keys: DataFrame, cuts: np.ndarray, weighed: np.ndarray, shards: int, law: str) -> tuple[np.ndarray, np.ndarray]:
    """The splitters and ranges with those subdivided in which a shard ends, until every shard ends at a splitter.

    Each turn looks into at most shards - 1 ranges: at all keys of small ones, at a sample of large ones.
    """
    while len(over := _cut(weighed, shards, law)):
        inside = ranged(keys, cuts).where(F.col("range").isin(over.tolist()))
        rows = int(weighed[np.isin(weighed[:, 0], over), 1].sum())
        if rows <= RANGE_ROWS * 32 * shards:
            more = inside.select("h", "t").distinct().toPandas().to_numpy(np.int64)  # a bounded number
        else:
            more = _sampled(inside, 0.0, RANGE_ROWS * 16 * shards / rows)
        new = np.unique(np.concatenate([cuts, more]), axis=0)
        if len(new) == len(cuts):
            return cuts, weighed  # keys that are equal can't be told apart
        cuts = new
        counted = ranged(keys, cuts).groupBy("range").agg(F.count("*").alias("n"), F.sum("size").alias("b")).toPandas().sort_values("range")
        weighed = counted[["range", "n", "b"]].to_numpy(np.int64)
    return cuts, weighed


def shard(docs: DataFrame, shards: int = SHARDS, law: str = "bytes", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard and slot (gapless in each shard, in key order) of every row."""
    if law not in ("bytes", "rows"):
        raise ValueError(f"unknown law: {law}")
    t = text_of(text)
    slim = docs.select(docs[doc_id].cast("long").alias("doc_id"), (F.octet_length(t) + 1).cast("long").alias("size"), F.crc32(t.cast("binary")).alias("text_crc32"), F.xxhash64(t).alias("h"), F.monotonically_increasing_id().alias("n"))
    keys = written(slim.select("doc_id", "size", "text_crc32", "h", F.xxhash64("doc_id", "n").alias("t")), "shard-keys")
    rows, size = keys.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    cuts, weighed = borders(keys, *splitters(keys, rows, size), shards, law)
    own = _shard_of(weighed, shards, law)
    start = np.cumsum(weighed[:, 1]) - weighed[:, 1]
    head = {int(s): int(start[i]) for i, s in reversed(list(enumerate(own)))}  # the row that each shard begins with
    base = pd.DataFrame({"range": weighed[:, 0], "shard": own.astype(np.int32), "n0": start - np.array([head[int(s)] for s in own], np.int64)})
    base = keys.sparkSession.createDataFrame(base, "range long, shard int, n0 long") if len(base) else keys.sparkSession.createDataFrame([], "range long, shard int, n0 long")
    inside = Window.partitionBy("range").orderBy("h", "t", "doc_id")
    placed = ranged(keys, cuts).withColumn("i", F.row_number().over(inside) - 1).join(F.broadcast(base), "range")  # a row a range
    return placed.select("doc_id", "size", "text_crc32", F.lit(law).alias("law"), "shard", (F.col("n0") + F.col("i")).alias("slot"))


def op5_sharding_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in one of 8 shards of near equal sizes."""
    return shard(table(spark, sf_dir, "documents")).withColumn("grown_shard", F.lit(None).cast("int"))
