"""Global ranks, range sort, column sort, checks and limits; no step sorts all rows in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans import padding
from ..sources.tables import fixed_prefix, written


def ranked(df: DataFrame, order: list[str], name: str = "rank") -> DataFrame:
    """df with its global row number (from 1) in an order: ranges are sorted apart, and numbers start after those of earlier ranges.

    Only a count for each range is joined back, a row a task.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    rows = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("__g", F.monotonically_increasing_id())
    rows = written(rows, "ranked").withColumn("__task", F.shiftright("__g", 33))
    before = 0
    starts = []
    for r in rows.groupBy("__task").count().orderBy("__task").collect():
        starts.append((r["__task"], before))
        before += r["count"]
    base = df.sparkSession.createDataFrame(starts, "__task long, __before long")
    inside = F.col("__g").bitwiseAND(F.lit((1 << 33) - 1))
    return rows.join(F.broadcast(base), "__task").withColumn(name, F.col("__before") + inside + 1).drop("__g", "__task", "__before")


def range_sort(lines: DataFrame, line: str = "line", prefix: int = 10) -> DataFrame:
    """Lines with prefix, rest and global row number, sorted by prefix, then rest."""
    first, rest = fixed_prefix(F.col(line), prefix)
    return ranked(lines.select(first.alias("prefix"), rest.alias("rest")), ["prefix", "rest"], "row_no")


def column_shape(rows: int, columns: int) -> int:
    """Rows of each column: a multiple of the columns, at least 2 (columns - 1)^2."""
    r = max(-(-rows // columns), 2 * (columns - 1) ** 2, 1)
    return -(-r // columns) * columns


def column_number(rows: int) -> int:
    """The most columns that a table may be cut into: a column has at least 2 (columns - 1)^2 rows."""
    c = max(1, int((rows / 2) ** (1 / 3)) + 2)
    while c > 1 and c * 2 * (c - 1) ** 2 > rows:
        c -= 1
    return c


def column_sort(df: DataFrame, key: str, row: str, columns: int | None = None) -> DataFrame:
    """key, its position and its column after a five-pass column sort (Leighton): sort columns, transpose, sort, transpose
    back, sort, shift by half a column, sort, shift back. Each pass sorts one column in one task; by default there are as many
    columns as the method allows, so both tasks and rows in a task grow with the table (10^9 rows: 794 tasks). Padding rows
    order last and are dropped."""
    n = df.count()
    columns = column_number(n) if columns is None else columns
    r = column_shape(n, columns)
    now = padding.rectangular(df.select(key, row), r * columns)
    # an even deal: a fixed position for each row, the padding at the end
    now = ranked(now.withColumn("__h", F.xxhash64(row)), ["is_fake", "__h", row], "__i")
    now = now.withColumn("col", ((F.col("__i") - 1) / r).cast("int")).drop("__i", "__h")

    def deal(t: DataFrame, to, name: str) -> DataFrame:
        pos = F.row_number().over(Window.partitionBy("col").orderBy("is_fake", key, row)) - 1
        return written(t.withColumn("__p", pos).withColumn("col", to(F.col("col"), F.col("__p")).cast("int")).drop("__p"), name)

    now = deal(now, lambda c, p: (c * r + p) % columns, "transposed")
    now = deal(now, lambda c, p: F.floor(p * columns / r), "back")
    now = deal(now, lambda c, p: F.floor((c * r + p + r // 2) / r), "down")
    # in shifted columns, all but the first begin at c * r - r / 2; the first holds r - r / 2 rows
    pos = F.row_number().over(Window.partitionBy("col").orderBy("is_fake", key, row)) - 1
    line = F.when(F.col("col") == 0, pos).otherwise(F.col("col") * r - r // 2 + pos)
    done = now.withColumn("rank", (line + 1).cast("bigint")).withColumn("reducer_id", F.floor(line / r).cast("int"))
    return done.where(~F.col("is_fake")).select(key, "rank", "reducer_id")


def order_violations(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """How often a key is below its predecessor in an order: neighbours in a part by a window, and the first and last key of each part."""
    rows = ranked(df.select(key, *[c for c in order if c != key]), order, "__n")
    nxt = rows.select((F.col("__n") + 1).alias("__n"), F.col(key).alias("__before"))
    return rows.join(nxt, "__n").agg(F.count_if(F.col(key) < F.col("__before")).alias("violations"))


def top(df: DataFrame, by: str, tie: list[str], n: int = 20) -> DataFrame:
    """The n rows with the largest value; ties by other columns. Each task keeps n rows."""
    return df.orderBy(F.col(by).desc(), *tie).limit(n)
