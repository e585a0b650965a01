"""Stateless and windowed stream operators."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bandwise.operators import fit
from bandwise.params import Params
from bandwise.sources.events import accept, normalize

# Fixed value: time of the row that ends a bounded input; every event is earlier.
END = datetime(9000, 1, 1, tzinfo=UTC)
MARK = "timestamp timestamp"


def stream_events(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    params: Params,
    *,
    fmt: str = "parquet",
    columns: Mapping[str, str] | None = None,
    timestamp_unit: str = "seconds",
    house_id: int | None = None,
    property_value: int = 1,
    options: Mapping[str, str] | None = None,
) -> DataFrame:
    """Accepted events of a file stream (or any source Spark knows, by ``fmt`` and ``options``).

    Normalisation and filters are those of the batch reader.
    """
    source = spark.readStream.format(fmt).schema(schema).options(**dict(options or {})).load(path)
    events = normalize(source, columns=columns, timestamp_unit=timestamp_unit)
    return accept(events, params, house_id=house_id, property_value=property_value)


def predict_stream(
    events: DataFrame, slots: DataFrame, plugs: DataFrame, slot_seconds: int
) -> DataFrame:
    """Seasonal prediction by stream-static joins with the fitted medians."""
    return fit.predict(events, slots, plugs, slot_seconds)


def end_marks(spark: SparkSession, marks: str) -> DataFrame:
    """Stream of the end mark in the folder ``marks``, of times only."""
    spark.createDataFrame([], MARK).write.mode("append").parquet(marks)
    return spark.readStream.schema(MARK).parquet(marks)


def until_end(events: DataFrame, marks: str) -> DataFrame:
    """Events of a bounded stream and the end mark, once there is one in the folder ``marks``."""
    return events.unionByName(end_marks(events.sparkSession, marks), allowMissingColumns=True)


def watermarked(events: DataFrame, delay: str) -> DataFrame:
    """Events under a watermark; an end mark moves the watermark and goes no further.

    A condition on the watermarked column is not pushed below the watermark.
    """
    return events.withWatermark("timestamp", delay).where(F.col("timestamp") < F.lit(END))


def batch_rollup(events: DataFrame, delay: str) -> DataFrame:
    """Load of every house and timestamp, emitted once the watermark has passed it."""
    return (
        watermarked(events, delay)
        .groupBy("house_id", "timestamp")
        .agg(
            F.sum("value").alias("actual_house"),
            F.count("*").alias("event_count"),
        )
    )


def allocation_windows(events: DataFrame, params: Params, delay: str) -> DataFrame:
    """Allocation periods aligned to the evaluation start; the tick is the first event in one."""
    length = f"{params.period_seconds} seconds"
    offset_us = params.start_us % params.period_us
    return (
        watermarked(events, delay)
        .groupBy(
            "house_id", F.window("timestamp", length, length, f"{offset_us} microseconds")
        )
        .agg(F.min("timestamp").alias("allocation_timestamp"), F.count("*").alias("events"))
        .select("house_id", F.col("window.start").alias("period_start"),
                "allocation_timestamp", "events")
    )


def stream_spells(events: DataFrame, gap_seconds: int, delay: str) -> DataFrame:
    """Activity spells as session windows; a gap of exactly ``gap_seconds`` does not end one."""
    return (
        watermarked(events, delay)
        .groupBy(
            "house_id",
            "household_id",
            "plug_id",
            F.session_window("timestamp", f"{gap_seconds} seconds"),
        )
        .agg(F.count("*").alias("events"), F.max("timestamp").alias("spell_end"))
        .select(
            "house_id",
            "household_id",
            "plug_id",
            F.col("session_window.start").alias("spell_start"),
            "spell_end",
            "events",
        )
    )
