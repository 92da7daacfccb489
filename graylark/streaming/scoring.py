"""Extensions for streams: the same transforms over arriving messages, and windowed verdict counts."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graylark.plans.funnel import verdicts


def message_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int = 16) -> DataFrame:
    """Parquet files of raw messages as they arrive below ``path``; a single file is watched by its name."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    folder, _, name = path.rstrip("/").rpartition("/")
    local = path.removeprefix("file://")
    return reader.option("pathGlobFilter", name).parquet(folder) if os.path.isfile(local) else reader.parquet(path)


def scored_stream(messages: DataFrame, raw: str = "raw_eml") -> DataFrame:
    """Verdicts for each arriving message; stateless, the same plan as for a table."""
    return verdicts(messages, raw)


def windowed_counts(results: DataFrame, time: str = "received_at", width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Verdicts per window of event time; windows close ``late`` behind the newest event, later rows are left out."""
    return results.where(F.col(time).isNotNull()).withWatermark(time, late).groupBy(F.window(time, width).alias("w"), "final_verdict").agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), "final_verdict", "n")


def running_counts(results: DataFrame) -> DataFrame:
    """Verdict counts since the start (complete mode): state is one row per verdict."""
    return results.groupBy("final_verdict").agg(F.count("*").alias("n"))
