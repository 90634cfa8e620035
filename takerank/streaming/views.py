"""Incremental views: votes in force, sessions and hopping windows over streams. The batch operators stay the truth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOTE_SCHEMA = "event_id long, usuario long, tramo long, ts timestamp, evento string, deshace string"


def vote_stream(spark, path: str) -> DataFrame:
    """Vote events as JSON lines arriving in a folder; broken lines are dropped."""
    return spark.readStream.schema(VOTE_SCHEMA).option("mode", "DROPMALFORMED").json(path)


def votes_in_force(events: DataFrame, watermark: str | None = None, kinds: tuple[str, ...] = ("like", "star")) -> DataFrame:
    """The last vote or undo of a vote of each user and stretch, for complete or update mode; an undo stands for no vote when read."""
    e = events.withWatermark("ts", watermark) if watermark else events
    undo = (F.col("evento") == "undo") & ~F.coalesce(F.col("deshace") == "nota", F.lit(False))
    return e.where(F.col("evento").isin(*kinds) | undo).groupBy("usuario", "tramo").agg(F.max_by("evento", F.struct("ts", "event_id")).alias("evento"), F.max("ts").alias("ts"))


def session_stream(events: DataFrame, key: str, ts: str = "ts", gap: str = "12 hours", watermark: str = "1 day") -> DataFrame:
    """Sessions of a key, emitted once the watermark has passed their end."""
    return events.withWatermark(ts, watermark).groupBy(key, F.session_window(ts, gap).alias("session")).agg(F.count("*").alias("n")).select(key, F.col("session.start").alias("start"), F.col("session.end").alias("end"), "n")


def hopping(events: DataFrame, ts: str, length: str, hop: str, value: str) -> DataFrame:
    """Count and mean by hopping windows over event time."""
    return events.groupBy(F.window(ts, length, hop).alias("w")).agg(F.count("*").alias("n"), F.avg(value).alias("mean")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "mean")
