"""Event tables: scan, normalise, filter, curate."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bandwise.functions.time import to_utc
from bandwise.params import Params

PLUG = ["house_id", "household_id", "plug_id"]
EVENT_ORDER = ["timestamp", "household_id", "plug_id", "row_id"]
EVENT_COLUMNS = [
    "event_id",
    "timestamp",
    "value",
    "property",
    "plug_id",
    "household_id",
    "house_id",
    "row_id",
]
# Target name -> default source name.
DEFAULT_COLUMNS = {
    "id": "id",
    "timestamp": "timestamp",
    "value": "value",
    "property": "property",
    "plug_id": "plug_id",
    "household_id": "household_id",
    "house_id": "house_id",
}
# Position of a row inside a set of files: file number times this, plus the row number in the file.
_FILE_STRIDE = 1 << 40
# The same file may be listed with one or three slashes after its scheme.
_SCHEME = r"^([A-Za-z0-9+.-]+):/+"


def read_events(
    spark: SparkSession,
    path: str,
    fmt: str,
    *,
    columns: Mapping[str, str] | None = None,
    timestamp_unit: str = "seconds",
    timestamp_format: str | None = None,
) -> DataFrame:
    """Scan a CSV or Parquet event table into the target schema, without filtering.

    Without an id a row is numbered by its file, in the order of names, and its place in the file;
    the numbers do not depend on how Spark splits the files.
    """
    if fmt == "csv":
        # cells stay text; casts decide what is readable, so no inference pass is needed
        frame = spark.read.option("header", True).csv(path)
        names = {**DEFAULT_COLUMNS, **(columns or {})}
        has_id = names["id"] in frame.columns
        _require(names, frame)
        return normalize(
            frame if has_id else _with_line_position(frame),
            columns=columns,
            timestamp_unit=timestamp_unit,
            timestamp_format=timestamp_format,
            row_id=None if has_id else F.col("_row_position"),
        )
    if fmt == "parquet":
        frame = spark.read.parquet(path)
        return normalize(
            _with_file_position(frame), columns=columns, timestamp_unit=timestamp_unit,
            timestamp_format=timestamp_format, row_id=F.col("_row_position"),
        )
    raise ValueError(f"unknown event format: {fmt}")


def _file_numbers(frame: DataFrame) -> DataFrame:
    """Files of a scan by the order of their names: a listing, not data."""
    files = sorted(frame.inputFiles())
    return frame.sparkSession.createDataFrame(
        [(re.sub(_SCHEME, r"\1:/", name), number) for number, name in enumerate(files)],
        "_file string, _number bigint",
    )


def _file_name() -> Column:
    return F.regexp_replace(F.col("_metadata.file_path"), _SCHEME, "$1:/")


def _with_file_position(frame: DataFrame) -> DataFrame:
    numbers = _file_numbers(frame)
    position = F.col("_number") * F.lit(_FILE_STRIDE) + F.col("_metadata.row_index")
    placed = frame.select("*", "_metadata").withColumn("_file", _file_name())
    return (
        placed.join(numbers, "_file", "left")
        .withColumn("_row_position", position)
        .drop("_metadata", "_file", "_number")
    )


def _with_line_position(frame: DataFrame) -> DataFrame:
    """Row numbers of text files, which have no row index, in two passes.

    The first counts the rows of every split; running sums over the splits of a file give the number
    of each split's first row, and the second pass counts on from there.  Both passes are scans of
    one plan and see the same splits; a row without its split is an error.
    """
    split = ["_file", "_start", "_length"]
    scanned = frame.select(
        "*",
        _file_name().alias("_file"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.col("_metadata.file_block_length").alias("_length"),
        # grows along a split by one a row
        F.monotonically_increasing_id().alias("_place"),
    )
    sizes = scanned.groupBy(*split).agg(
        F.count("*").alias("_rows"), F.min("_place").alias("_first")
    )
    before = Window.partitionBy("_file").orderBy("_start")
    sizes = sizes.withColumn(
        "_offset",
        F.coalesce(
            F.sum("_rows").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ),
    )
    starts = sizes.join(_file_numbers(frame), "_file", "left")
    inside = F.col("_place") - F.col("_first")
    position = F.when(
        inside.between(F.lit(0), F.col("_rows") - 1),
        F.col("_number") * F.lit(_FILE_STRIDE) + F.col("_offset") + inside,
    ).otherwise(F.raise_error(F.lit("the files were split in two ways; read them again")))
    return (
        scanned.join(starts, split, "left")
        .withColumn("_row_position", position)
        .drop(*split, "_place", "_rows", "_first", "_offset", "_number")
    )


def _require(names: Mapping[str, str], frame: DataFrame) -> None:
    missing = {source for target, source in names.items() if target != "id"} - set(frame.columns)
    if missing:
        raise ValueError(f"missing required columns: {sorted(missing)}")


def normalize(
    frame: DataFrame,
    *,
    columns: Mapping[str, str] | None = None,
    timestamp_unit: str = "seconds",
    timestamp_format: str | None = None,
    row_id: Column | None = None,
) -> DataFrame:
    """Rename and cast source columns; unreadable cells become null, missing columns are an error.

    Works on batch and streaming frames.  Without a row position the order inside one timestamp
    comes from the data itself: the id if it is a number, else a hash of the whole row, which wholly
    equal rows share.
    """
    names = {**DEFAULT_COLUMNS, **(columns or {})}
    _require(names, frame)
    has_id = names["id"] in frame.columns
    if row_id is None:
        content = F.xxhash64(*[F.col(c) for c in frame.columns])
        if has_id:
            row_id = F.coalesce(F.col(names["id"]).cast("string").try_cast("bigint"), content)
        else:
            row_id = content
    stamp = to_utc(
        names["timestamp"],
        frame.schema[names["timestamp"]].dataType,
        timestamp_unit,
        timestamp_format,
    )
    whole = [names[c] for c in ("property", "plug_id", "household_id", "house_id")]
    prepared = frame.select(
        (F.col(names["id"]) if has_id else F.lit(None)).cast("string").alias("_id"),
        stamp.alias("timestamp"),
        F.col(names["value"]).try_cast("double").alias("value"),
        *[
            F.col(source).try_cast("bigint").alias(target)
            for source, target in zip(
                whole, ("property", "plug_id", "household_id", "house_id"), strict=True
            )
        ],
        row_id.cast("bigint").alias("row_id"),
    )
    return prepared.withColumn(
        "event_id", F.coalesce(F.col("_id"), F.col("row_id").cast("string"))
    ).select(*EVENT_COLUMNS)


def _never_null(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def house_matches(house_id: int | None) -> Column:
    if house_id is None:
        return F.col("house_id").isNotNull()
    return _never_null(F.col("house_id") == F.lit(house_id))


def property_matches(value: int) -> Column:
    return _never_null(F.col("property") == F.lit(value))


def valid_value() -> Column:
    """Present, finite and not negative (Spark orders NaN above infinity)."""
    value = F.col("value")
    return _never_null(~F.isnan(value) & (value < F.lit(float("inf"))) & (value >= F.lit(0.0)))


def in_study_range(params: Params) -> Column:
    return _never_null(
        F.col("timestamp").between(F.lit(params.warmup[0]), F.lit(params.evaluation[1]))
    )


def accept(
    events: DataFrame, params: Params, *, house_id: int | None = None, property_value: int = 1
) -> DataFrame:
    """Rows of the selected house(s) and property with a valid value inside the study range."""
    return events.where(
        house_matches(house_id)
        & property_matches(property_value)
        & valid_value()
        & in_study_range(params)
    ).select(*EVENT_COLUMNS)


def filter_counts(
    events: DataFrame,
    params: Params,
    *,
    house_id: int | None = None,
    property_value: int = 1,
    by_house: bool = False,
) -> DataFrame:
    """Rejection waterfall in one pass; the first failing reason counts."""
    house, prop = house_matches(house_id), property_matches(property_value)
    valid, ranged = valid_value(), in_study_range(params)
    outcome = events.select(
        "house_id",
        F.when(~house, "wrong_house")
        .when(~prop, "wrong_property")
        .when(~valid, "invalid_value")
        .when(~ranged, "outside_experiment_range")
        .otherwise("accepted_rows")
        .alias("outcome"),
    )
    reasons = (
        "wrong_house",
        "wrong_property",
        "invalid_value",
        "outside_experiment_range",
        "accepted_rows",
    )
    grouped = outcome.groupBy("house_id") if by_house else outcome.groupBy()
    return grouped.agg(
        F.count("*").alias("input_rows"),
        *[F.count_if(F.col("outcome") == reason).alias(reason) for reason in reasons],
    )


def require_rows(counts: DataFrame, house_id: int | None = None) -> dict[str, int]:
    """Fail early if the house is unknown or nothing was accepted; returns the counts."""
    row = counts.first().asDict()
    if row["input_rows"] - row["wrong_house"] == 0:
        raise ValueError(f"selected house {house_id} has no rows")
    if row["accepted_rows"] == 0:
        raise ValueError("no valid rows remain after filtering")
    return row


def write_curated(events: DataFrame, path: str, *, mode: str = "errorifexists") -> None:
    """Store accepted events by house and day, sorted by event order, for pruned re-reads.

    The day spreads one large house over many tasks and files.
    """
    (
        events.withColumn("event_date", F.to_date("timestamp"))
        .repartition("house_id", "event_date")
        .sortWithinPartitions("house_id", *EVENT_ORDER)
        .write.mode(mode)
        .partitionBy("house_id", "event_date")
        .parquet(path)
    )


def read_curated(
    spark: SparkSession, path: str, start=None, end=None, *, house_id: int | None = None
) -> DataFrame:
    """Closed time range of a curated table; prunes partitions and row groups."""
    frame = spark.read.parquet(path)
    frame = frame.withColumn("house_id", F.col("house_id").cast("bigint"))
    if house_id is not None:
        frame = frame.where(F.col("house_id") == house_id)
    if start is not None:
        frame = frame.where(
            (F.col("event_date") >= F.lit(start.date())) & (F.col("timestamp") >= F.lit(start))
        )
    if end is not None:
        frame = frame.where(
            (F.col("event_date") <= F.lit(end.date())) & (F.col("timestamp") <= F.lit(end))
        )
    return frame.select(*EVENT_COLUMNS)
