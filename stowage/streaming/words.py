"""An addition beyond batch parity: counts that follow a stream of records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def event_counts(stream: DataFrame, time: str = "ts", key: str = "event_type", window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Rows of each key and time window; rows later than the watermark are dropped, and closed windows leave the state."""
    return stream.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), key).agg(F.count("*").alias("cnt")).select("w.start", "w.end", key, "cnt")


def word_counts(stream: DataFrame, text: str = "text") -> DataFrame:
    """A running word count, for update or complete output."""
    words = stream.select(F.explode(F.split(F.lower(text), r"\W+")).alias("word")).where("word <> ''")
    return words.groupBy("word").agg(F.count("*").alias("cnt"))
