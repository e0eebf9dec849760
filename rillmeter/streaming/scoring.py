"""Scoring a stream of profiles.

Scoring is a projection, so there is no state, no watermark and no shuffle; a
restarted query resumes from its checkpoint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from rillmeter.operators.scoring import ANOMALY_DISTANCE, Scorer, score_profiles


def read_profiles(spark: SparkSession, folder: str, schema, files: str = "*.parquet", files_per_trigger: int | None = None) -> DataFrame:
    """Profiles arriving as Parquet files in a folder."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", files)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def score_stream(profiles: DataFrame, scorer: Scorer, threshold: float = ANOMALY_DISTANCE) -> DataFrame:
    return score_profiles(profiles, scorer, threshold)


def write_scores(scored: DataFrame, out_dir: str, checkpoint_dir: str, available_now: bool = False) -> StreamingQuery:
    """Append scored profiles as Parquet, exactly once; optionally stop once caught up."""
    writer = (
        scored.writeStream.format("parquet")
        .option("path", out_dir)
        .option("checkpointLocation", checkpoint_dir)
        .outputMode("append")
    )
    return (writer.trigger(availableNow=True) if available_now else writer).start()
