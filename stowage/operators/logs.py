"""Analytics over run logs: driver events, timing blocks, monitor metrics and plot data."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import system_class, unit_value
from ..sources.tables import written

# Words of Spark's driver log and of the time command.
STAMP = r"\d\d/\d\d/\d\d \d\d:\d\d:\d\d"
STAMP_FORMAT = "yy/MM/dd HH:mm:ss"
TIMES = r"real\s+(\d+)m([\d.]+)s\s+user\s+(\d+)m([\d.]+)s\s+sys\s+(\d+)m([\d.]+)s"
EXECUTOR = r"Registered executor .*?\bID (?<id>\d+)"
JOB = r"Job (?<id>\d+) finished: (?<what>\S.*?)\s+at (?<where>[^,\s]+), took (?<took>\d+(?:\.\d+)?) s"
STAGE = r"Submitting .*?\b(?<kind>ResultStage|ShuffleMapStage) (?<id>\d+)"
TASK = r"Starting task (?<task>\d+\.\d+) in stage (?<stage>\d+\.\d+) \(TID (?<id>\d+)\) \((?<host>[^,]+), executor (?<executor>\w+),"
#: Runs whose start times are broadcast; with more the join is a shuffled one.
FEW_RUNS = 100_000


def _events(lines: DataFrame, pattern: str, line: str, run: str) -> DataFrame:
    """Lines that match, with their timestamp, seconds since the run's first timestamp, and `found`: the pattern's groups in order."""
    stamp = F.regexp_extract(line, f"^{STAMP}", 0)
    stamped = lines.where(stamp != "").withColumn("timestamp", F.to_timestamp(stamp, STAMP_FORMAT))
    start = written(stamped.groupBy(run).agg(F.min("timestamp").alias("__start")), "run-starts")
    start = F.broadcast(start) if start.count() <= FEW_RUNS else start
    groups = pattern.count("(?<")
    found = stamped.where(F.col(line).rlike(pattern)).withColumn("found", F.array(*[F.regexp_extract(line, pattern, i + 1) for i in range(groups)]))
    return found.join(start, run).withColumn("elapsed_sec", (F.unix_timestamp("timestamp") - F.unix_timestamp("__start")).cast("double"))


def _columns(lines: DataFrame, pattern: str, line: str, run: str, **types: str) -> DataFrame:
    """run, timestamp, elapsed_sec and the named groups, in the order of the pattern, cast to their types."""
    found = _events(lines, pattern, line, run)
    return found.select(run, "timestamp", "elapsed_sec", *[F.col("found")[i].cast(t).alias(n) for i, (n, t) in enumerate(types.items())])


def executors(lines: DataFrame, line: str = "line", run: str = "run") -> DataFrame:
    return _columns(lines, EXECUTOR, line, run, executor_id="string")


def jobs(lines: DataFrame, line: str = "line", run: str = "run") -> DataFrame:
    return _columns(lines, JOB, line, run, job_id="int", description="string", location="string", duration_sec="double")


def stages(lines: DataFrame, line: str = "line", run: str = "run") -> DataFrame:
    return _columns(lines, STAGE, line, run, type="string", stage_id="int")


def tasks(lines: DataFrame, line: str = "line", run: str = "run") -> DataFrame:
    return _columns(lines, TASK, line, run, task_number="string", stage_id="string", task_id="string", host="string", executor_id="string")


def timings(blocks: DataFrame, text: str = "text") -> DataFrame:
    """real, user and sys seconds of a block that the time command prints."""
    part = lambda i: F.regexp_extract(text, TIMES, i).cast("double")
    seconds = lambda i: part(i) * 60 + part(i + 1)
    return blocks.where(F.col(text).rlike(TIMES)).withColumns({"real": seconds(1), "user": seconds(3), "sys": seconds(5)})


def overheads(times: DataFrame, group: str, order: str, metrics: tuple[str, ...] = ("real", "user", "sys")) -> DataFrame:
    """Each run's metrics with their ratios to the group's first run and to the run before."""
    w = Window.partitionBy(group).orderBy(order)
    out = times
    for m in metrics:
        out = out.withColumns({f"{m}_overhead": F.col(m) / F.first(m).over(w), f"{m}_delta": F.col(m) / F.lag(m).over(w)})
    return out


def metric_summary(df: DataFrame, metric: str, value: str) -> DataFrame:
    """Maximum, mean and population deviation of each metric."""
    return df.groupBy(metric).agg(F.max(value).alias("max_value"), F.avg(value).alias("mean_value"), F.stddev_pop(value).alias("sd_value"))


def label_data(df: DataFrame, label: str, cell: str, marks: tuple[tuple[str, str], ...], other: str) -> DataFrame:
    """Bar-chart rows: without nulls, the label's last 25 characters, the cell's number and kind, and the system's class: that of the first (mark, class) whose mark the label holds."""
    number, kind = unit_value(F.col(cell))
    return df.dropna(subset=[label, cell]).select(F.substring(label, -25, 25).alias("label"), number.alias("value"), kind.alias("kind"), system_class(F.col(label), marks, other).alias("system"))


def heap_pressure(runs: DataFrame, baseline: DataFrame) -> DataFrame:
    """Runs that ended well on both sides, their elapsed seconds less the baseline's (at least 0), and heap for each thread; means by collector.

    runs: gc_type, num_threads, heap_size_mb, elapsed, native_exit, shielded_exit; baseline: one row, base_elapsed.
    """
    found = baseline.limit(2).collect()
    if len(found) != 1:
        raise ValueError("a baseline is one row")
    ok = runs.where("native_exit = 0 and shielded_exit = 0").withColumn("base_elapsed", F.lit(float(found[0]["base_elapsed"])))
    extra = F.greatest(F.col("elapsed").try_cast("double") - F.col("base_elapsed"), F.lit(0.0))
    ok = ok.withColumns({"extra": extra, "heap_per_thread": F.col("heap_size_mb").cast("double") / F.col("num_threads")})
    return ok.groupBy("gc_type").agg(F.count("*").alias("runs"), F.avg("extra").alias("mean_extra"), F.avg("heap_per_thread").alias("mean_heap_per_thread"))
