"""The scan on a stream of units. It keeps no state but what tells findings apart that were reported before."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from sigilite.catalog import Config
from sigilite.operators.scan import scan


def scan_stream(units: DataFrame, config: Config = Config(), event_time: str | None = None, remember: str = "7 days") -> DataFrame:
    """Findings of a stream of units, as ``scan`` gives them.

    With ``event_time``, a column of ``units``, a fingerprint is reported once within ``remember``; findings
    later than the watermark are dropped, and state older than it is forgotten, so the state stays bounded.
    A null event time counts as late."""
    found = scan(units, config) if event_time is None else _timed(units, config, event_time)
    return found if event_time is None else found.withWatermark(event_time, remember).dropDuplicatesWithinWatermark(["fingerprint"])


def _timed(units: DataFrame, config: Config, event_time: str) -> DataFrame:
    """The scan leaves out further columns; the time rides along in the unit's ``commit`` and is taken off again."""
    stamp = F.date_format(event_time, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    commit = F.col("commit") if "commit" in units.columns else F.lit(None).cast("string")
    rows = scan(units.withColumn("commit", F.concat(F.coalesce(stamp, F.lit("")), F.lit("|"), F.coalesce(commit, F.lit("")))), config)
    time = F.to_timestamp(F.nullif(F.substring_index("commit", "|", 1), F.lit("")), "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return rows.withColumn(event_time, time).withColumn("commit", F.nullif(F.substring_index("commit", "|", -1), F.lit("")))


def window_counts(found: DataFrame, event_time: str, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Findings per window and severity."""
    return found.withWatermark(event_time, late).groupBy(F.window(event_time, width), "severity").agg(F.count("*").alias("n"))


def write(found: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    writer = found.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()
