"""Warm-up, validation and evaluation intervals."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bandwise.params import Interval, Params


def inside(span: Interval) -> Column:
    """Closed interval test that reaches the scan as a pushed filter."""
    return F.col("timestamp").between(F.lit(span[0]), F.lit(span[1]))


def assign_split(events: DataFrame, params: Params) -> DataFrame:
    """Add ``split``: warmup, validation, evaluation or null (in the gaps between them)."""
    label = F.when(inside(params.warmup), "warmup")
    if params.validation is not None:
        label = label.when(inside(params.validation), "validation")
    return events.withColumn("split", label.when(inside(params.evaluation), "evaluation"))


def split_counts(events: DataFrame, params: Params) -> DataFrame:
    """Rows per split and the covered time range, per house, in one pass."""
    split = assign_split(events, params)
    return split.groupBy("house_id").agg(
        F.count_if(F.col("split") == "warmup").alias("warmup_events"),
        F.count_if(F.col("split") == "validation").alias("validation_events"),
        F.count_if(F.col("split") == "evaluation").alias("evaluation_events"),
        F.count("*").alias("total_events"),
        F.min("timestamp").alias("first_timestamp"),
        F.max("timestamp").alias("last_timestamp"),
    )


def split_report(events: DataFrame, params: Params) -> DataFrame:
    """``split_counts`` with what is wrong per house: no warm-up under its evaluation, a late start,
    an early end."""
    return split_counts(events, params).withColumns(
        {
            "lacks_warmup": (F.col("warmup_events") == 0)
            & (F.col("validation_events") + F.col("evaluation_events") > 0),
            "starts_late": F.col("first_timestamp") > F.lit(params.warmup[0]),
            "ends_early": F.col("last_timestamp") < F.lit(params.evaluation[1]),
        }
    )


def check_splits(events: DataFrame, params: Params, slack: timedelta = timedelta(0)) -> None:
    """Raise if a split is empty everywhere, a house that is evaluated has no warm-up, or, with
    validation, the data of a house does not cover the study but for ``slack`` at either end.

    Only one aggregated row reaches the driver.
    """
    late = F.col("first_timestamp") > F.lit(params.warmup[0] + slack)
    short = F.col("last_timestamp") < F.lit(params.evaluation[1] - slack)
    row = (
        split_report(events, params)
        .agg(
            F.sum("warmup_events").alias("warmup"),
            F.sum("validation_events").alias("validation"),
            F.sum("evaluation_events").alias("evaluation"),
            F.count_if(late).alias("late"),
            F.min(F.when(late, F.col("house_id"))).alias("late_house"),
            F.count_if(short).alias("short"),
            F.min(F.when(short, F.col("house_id"))).alias("short_house"),
            F.count_if("lacks_warmup").alias("lacking"),
            F.min(F.when(F.col("lacks_warmup"), F.col("house_id"))).alias("example"),
        )
        .first()
    )
    if params.validation is not None and row["late"]:
        raise ValueError(
            f"input coverage starts after warm-up start in {row['late']} houses, the first is "
            f"{row['late_house']}"
        )
    if params.validation is not None and row["short"]:
        raise ValueError(
            f"input coverage ends before evaluation end in {row['short']} houses, the first is "
            f"{row['short_house']}"
        )
    for name in ("warmup", "validation", "evaluation"):
        if name == "validation" and params.validation is None:
            continue
        if not row[name]:
            raise ValueError(f"{name} split is empty")
    if row["lacking"]:
        raise ValueError(
            f"{row['lacking']} houses have no warm-up events, the first is {row['example']}"
        )
