"""The analysis document: one JSON row per log from summaries, distributions and PID errors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerolytics.operators import stats
from aerolytics.operators.frames import frame_counts


def analyze_logs(frames: DataFrame, config: DataFrame, validity: DataFrame | None = None, logs: DataFrame | None = None) -> DataFrame:
    """(log_id, document): what the analysis of one log says, as a struct; one pass over the frames, aggregates alone are shuffled.

    ``validity`` (from ``validate_logs``) gives the counts of valid and corrupt frames; without it all
    frames count as valid.  ``logs`` is (log_id, path, log_index).  A log without an axis, motors or time
    lacks them in the document.
    """
    found = stats.flight_statistics(frames, config).join(config.select("log_id", F.col("firmware_revision").alias("firmware"), "fc_version"), "log_id", "left")
    if validity is not None:
        found = found.join(frame_counts(validity), "log_id", "left")
    else:
        found = found.withColumns({"valid_frames": F.col("n"), "corrupt_frames": F.lit(0).cast("long")})
    if logs is not None:
        found = found.join(logs.select("log_id", F.col("path").alias("file"), "log_index"), "log_id", "left")
    else:
        found = found.withColumns({"file": F.lit(None).cast("string"), "log_index": F.lit(0)})
    deviations = F.transform_values("pid_error", lambda _, x: F.struct(x.alias("std")))
    motors = F.when(F.col("motors").isNotNull(), F.struct(F.col("motors.mean").alias("mean_percent"), F.col("motors.std").alias("std_percent")))
    return found.select("log_id", F.struct(
        "file", "log_index", "duration_s", "sample_rate_hz", "firmware", "fc_version", "valid_frames", "corrupt_frames",
        F.col("sticks").alias("stick_distributions"), deviations.alias("pid_error"), motors.alias("motor_stats")).alias("document"))


def write_documents(documents: DataFrame, path: str) -> None:
    """One JSON object per log."""
    documents.select("log_id", "document.*").write.mode("overwrite").json(path)
