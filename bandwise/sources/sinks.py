"""Result tables: writing, inspecting, and consolidating the summaries of many runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bandwise.operators.metrics import safety_pass

RESULT_ORDER = ("timestamp", "household_id", "plug_id", "event_id")
REPORT_FORMATS = ("csv", "json", "parquet")
INSPECTABLE = {
    "outliers": ("outlier_rank",),
    "drift_events": RESULT_ORDER,
    "resynchronization_events": RESULT_ORDER,
}

# Columns of the consolidated table.
CONSOLIDATED = (
    "source_group",
    "result_type",
    "source_path",
    "experiment_name",
    "input_sha256",
    "house_id",
    "evaluation_start",
    "evaluation_end",
    "allocator_mode",
    "predictor_mode",
    "valid_events",
    "timestamp_batches",
    "transmitted",
    "suppressed",
    "transmission_ratio",
    "reduction",
    "mae",
    "rmse",
    "p95",
    "p99",
    "cvar95",
    "cvar99",
    "max",
    "house_budget",
    "bound_violation_count",
    "suppression_violation_count",
    "budget_violation_count",
    "maximum_consecutive_suppression",
    "prediction_events",
    "prediction_mae",
    "prediction_rmse",
    "prediction_p95",
    "prediction_p99",
    "prediction_cvar95",
    "prediction_cvar99",
    "prediction_bias",
    "predictor_update_count",
    "predictor_update_rate",
    "drift_trigger_count",
    "additional_drift_transmission_count",
    "periodic_sync_count_trigger_count",
    "periodic_sync_time_trigger_count",
    "additional_periodic_transmission_count",
    "maximum_consecutive_suppressions_observed",
    "predictor_state_divergence_count",
    "safety_pass",
)
_TEXT = (
    "source_group",
    "result_type",
    "source_path",
    "experiment_name",
    "input_sha256",
    "evaluation_start",
    "evaluation_end",
    "allocator_mode",
    "predictor_mode",
)


def write_mode(overwrite: bool) -> str:
    return "overwrite" if overwrite else "errorifexists"


def result_order(df: DataFrame) -> list[str]:
    """Columns of the deterministic order: event order, or the trigger time."""
    columns = [c for c in RESULT_ORDER if c in df.columns]
    if "timestamp" in columns:
        return columns
    return ["trigger_timestamp"] if "trigger_timestamp" in df.columns else []


def in_result_order(df: DataFrame, partition_by: Sequence[str] = ()) -> DataFrame:
    """Rows dealt to tasks by ranges of the order and sorted inside them.

    The order holds over the files of a table in the order of their names, and inside every
    partition of a partitioned one: its columns come first, so a partition is written by the tasks of
    its own range only, and Spark has nothing to sort again.
    """
    order = [*partition_by, *(c for c in result_order(df) if c not in partition_by)]
    if not order:
        return df
    return df.repartitionByRange(*order).sortWithinPartitions(*order)


def write_report(
    df: DataFrame,
    path: str,
    fmt: str = "csv",
    *,
    overwrite: bool = False,
    one_file: bool = False,
) -> None:
    """A report table; CSV needs flat columns, JSON keeps maps.

    ``one_file`` is for tables of a run, house or day, which one task can write.
    """
    if fmt not in REPORT_FORMATS:
        raise ValueError(f"unknown report format: {fmt}")
    writer = (df.coalesce(1) if one_file else df).write.mode(write_mode(overwrite))
    if fmt == "csv":
        nested = [
            f.name
            for f in df.schema.fields
            if isinstance(f.dataType, (T.MapType, T.StructType, T.ArrayType))
        ]
        if nested:
            raise ValueError(f"flatten before writing CSV: {nested}")
        writer.option("header", True).csv(path)
    elif fmt == "json":
        writer.json(path)
    else:
        writer.parquet(path)


def write_table(
    df: DataFrame, path: str, *, overwrite: bool = False, partition_by: Sequence[str] = ()
) -> None:
    """A result table of any size as Parquet, sorted; an empty one keeps its schema.

    Overwriting a partitioned table replaces the partitions that the rows belong to, when the job is
    committed, and leaves the others.
    """
    writer = in_result_order(df, partition_by).write.mode(write_mode(overwrite))
    if partition_by:
        writer = writer.option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by)
    writer.parquet(path)


def inspect(spark: SparkSession, root: str, artifact: str, n: int = 20) -> DataFrame:
    """First rows of a written result table."""
    if artifact not in INSPECTABLE:
        raise ValueError(f"cannot inspect {artifact}")
    frame = spark.read.parquet(f"{root}/{artifact}")
    order = [c for c in INSPECTABLE[artifact] if c in frame.columns]
    return frame.orderBy(*order).limit(n)


def read_runs(spark: SparkSession, pattern: str, fmt: str = "parquet") -> DataFrame:
    """Summary tables of many runs by glob, in files of any of the report formats.

    Adds ``source_path``, the folder of the run's table, and ``source_group``, the folder above, unless
    the table has a group.  Columns that some runs lack are null there.
    """
    if fmt not in REPORT_FORMATS:
        raise ValueError(f"unknown report format: {fmt}")
    reader = spark.read.option("mergeSchema", True)
    if fmt == "csv":
        # files may have different headers, and a CSV scan takes one: each folder is read by its own
        frame = _read_csv_runs(spark, pattern)
    else:
        frame = reader.format(fmt).load(pattern)
    folder = F.regexp_replace(F.col("_metadata.file_path"), "/[^/]*$", "")
    frame = frame.select("*", folder.alias("source_path")) if fmt != "csv" else frame
    if "source_group" not in frame.columns:
        group = F.regexp_extract("source_path", "([^/]+)/[^/]*$", 1)
        frame = frame.withColumn("source_group", group)
    return frame


def _read_csv_runs(spark: SparkSession, pattern: str) -> DataFrame:
    plain = spark.read.option("header", True)
    folders = sorted({name.rsplit("/", 1)[0] for name in plain.csv(pattern).inputFiles()})
    merged = None
    for folder in folders:  # one report folder a run: a listing, not data
        part = plain.csv(folder).withColumn("source_path", F.lit(folder))
        merged = part if merged is None else merged.unionByName(part, allowMissingColumns=True)
    if merged is None:
        raise ValueError("no run summaries found")
    return merged


def consolidate(baselines: DataFrame | None, adaptive: DataFrame | None) -> DataFrame:
    """One table of all runs with a fixed set of columns; absent ones are null.

    Baselines bring ``mode``; adaptive runs bring ``allocator_mode``, ``predictor_mode`` and their
    prediction figures.
    """
    parts = []
    if baselines is not None:
        frozen = baselines.withColumn("allocator_mode", F.col("mode")).withColumns(
            {
                "result_type": F.lit("allocator_baseline"),
                "predictor_mode": F.lit("slot_median_frozen"),
                "safety_pass": safety_pass(),
            }
        )
        parts.append(frozen)
    if adaptive is not None:
        judged = adaptive.withColumns(
            {
                "result_type": F.lit("adaptive_predictor"),
                "safety_pass": safety_pass("predictor_state_divergence_count"),
            }
        )
        if "events" in judged.columns:
            judged = judged.withColumn("prediction_events", F.col("events"))
        parts.append(judged)
    if not parts:
        raise ValueError("no run summaries found")
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part, allowMissingColumns=True)
    # cells of CSV reports are text
    texts = {
        f.name
        for f in merged.schema.fields
        if isinstance(f.dataType, T.StringType) and f.name not in _TEXT
    }
    columns = [
        (F.col(name).try_cast("double").alias(name) if name in texts else F.col(name))
        if name in merged.columns
        else F.lit(None).cast("string" if name in _TEXT else "double").alias(name)
        for name in CONSOLIDATED
    ]
    return merged.select(*columns).orderBy("source_group", "allocator_mode", "predictor_mode")
