"""Reading, filtering, splitting, curating, writing."""

from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from bandwise.operators import fit, splits
from bandwise.params import Params, interval
from bandwise.plans.frozen import Study
from bandwise.sources import events as ev
from bandwise.sources import sinks
from tests.fixtures import SCHEMA, START, drifting_house, house_params

DAY = Params(
    warmup=interval("2013-09-01T00:00:00+00:00", "2013-09-01T05:59:59+00:00"),
    evaluation=interval("2013-09-01T06:00:00+00:00", "2013-09-01T11:59:59+00:00"),
)
HEADER = "timestamp,value,property,plug_id,household_id,house_id"
LINES = [
    "1378015200,3,1,2,1,0",
    "1377993600,2,1,2,1,0",
    "1377993600,1,1,1,1,0",
    "1377993600,-1,1,3,1,0",
    "1377993600,5,2,4,1,0",
    "1377993600,6,1,5,1,9",
]


@pytest.fixture()
def csv(tmp_path):
    path = tmp_path / "events.csv"
    path.write_text("\n".join([HEADER, *LINES]) + "\n")
    return str(path)


def test_filter_counts_and_order(spark, csv):
    raw = ev.read_events(spark, csv, "csv")
    counts = ev.require_rows(ev.filter_counts(raw, DAY, house_id=0), 0)
    assert counts == {
        "input_rows": 6,
        "wrong_house": 1,
        "wrong_property": 1,
        "invalid_value": 1,
        "outside_experiment_range": 0,
        "accepted_rows": 3,
    }
    rows = ev.accept(raw, DAY, house_id=0).orderBy(*ev.EVENT_ORDER).collect()
    assert [(r.plug_id, r.value) for r in rows] == [(1, 1.0), (2, 2.0), (2, 3.0)]
    assert len({r.event_id for r in rows}) == 3
    with pytest.raises(ValueError, match="has no rows"):
        ev.require_rows(ev.filter_counts(raw, DAY, house_id=77), 77)


def test_bad_cells_nan_infinity_and_null_are_invalid(spark):
    values = ["1.5", "abc", "NaN", "Infinity", "-0.5", None, "0"]
    raw = spark.createDataFrame(
        [("2013-09-01 01:00:00", v, "1", str(i), "1", "0") for i, v in enumerate(values)],
        "timestamp string, value string, property string, plug_id string, household_id string, "
        "house_id string",
    )
    kept = ev.accept(ev.normalize(raw), DAY).collect()
    assert sorted(r.value for r in kept) == [0.0, 1.5]
    assert ev.filter_counts(ev.normalize(raw), DAY).first().invalid_value == 5


def test_missing_columns_are_named(spark):
    raw = spark.createDataFrame([(1, 2.0)], "timestamp bigint, value double")
    with pytest.raises(ValueError, match="house_id.*household_id.*plug_id.*property"):
        ev.normalize(raw)


@pytest.mark.parametrize(
    "unit,number", [("seconds", 1), ("milliseconds", 1_000), ("microseconds", 1_000_000)]
)
def test_epoch_units_and_text(spark, unit, number):
    at = 1_378_000_000
    for kind, cell in (("bigint", at * number), ("string", str(at * number))):
        raw = spark.createDataFrame(
            [(cell, 1.0, 1, 1, 1, 0)],
            f"timestamp {kind}, value double, property bigint, plug_id bigint, "
            "household_id bigint, house_id bigint",
        )
        got = ev.normalize(raw, timestamp_unit=unit).select(F.unix_seconds("timestamp")).first()[0]
        assert got == at
    text = spark.createDataFrame(
        [("2013-09-01T02:46:40Z", 1.0, 1, 1, 1, 0), ("never", 1.0, 1, 1, 1, 0)],
        "timestamp string, value double, property bigint, plug_id bigint, household_id bigint, "
        "house_id bigint",
    )
    stamps = [r[0] for r in ev.normalize(text).select(F.unix_seconds("timestamp")).collect()]
    assert stamps == [1378003600, None]


def test_parquet_row_positions_over_several_files(spark, tmp_path):
    path = str(tmp_path / "p")
    rows = [(1377993600 + i, float(i), 1, i, 7, 3) for i in range(40)]
    names = "timestamp bigint, value double, property bigint, plug_id bigint, household_id " \
        "bigint, house_id bigint"
    spark.createDataFrame(rows, names).repartition(4).write.parquet(path)
    got = ev.read_events(spark, path, "parquet")
    assert got.select("row_id").distinct().count() == 40
    assert {r.event_id for r in got.collect()} == {str(r.row_id) for r in got.collect()}


def test_splits_loads_and_predictions(spark):
    params = Params(
        warmup=interval(START, START + timedelta(minutes=30)),
        evaluation=interval(START + timedelta(days=7), START + timedelta(days=7, minutes=30)),
    )
    minutes = [(0, 1.0), (1, 3.0), (10, 9.0)]
    rows = [
        (str(i), START + timedelta(minutes=m), v, 1, 1, 1, 0, i) for i, (m, v) in enumerate(minutes)
    ]
    later = START + timedelta(days=7)
    asked = [
        ("a", later, 0.0, 1, 1, 1, 0, 10),
        ("b", later + timedelta(minutes=5), 0.0, 1, 1, 1, 0, 11),
        ("c", later, 0.0, 1, 2, 1, 0, 12),
    ]
    whole = spark.createDataFrame([*rows, *asked], SCHEMA)
    splits.check_splits(whole, params)
    warm = whole.where(splits.inside(params.warmup))
    slots, plugs = fit.slot_medians(warm, 300), fit.plug_medians(warm)
    predicted = fit.predict(whole.where(splits.inside(params.evaluation)), slots, plugs, 300)
    got = {r.event_id: r.prediction for r in predicted.collect()}
    assert got == {"a": 2.0, "b": 3.0, "c": None}
    assert fit.mean_loads(warm).first().mean_load == pytest.approx(13 / 3)
    with pytest.raises(ValueError, match="evaluation split is empty"):
        splits.check_splits(warm, params)


def test_interval_rules():
    with pytest.raises(ValueError, match="overlap"):
        Params(
            warmup=interval("2013-09-01", "2013-09-02"),
            evaluation=interval("2013-09-02", "2013-09-03"),
        )
    with pytest.raises(ValueError, match="timezone"):
        interval(datetime(2013, 9, 1), datetime(2013, 9, 2, tzinfo=UTC))
    with pytest.raises(ValueError, match="start must be"):
        interval("2013-09-02", "2013-09-01")


def test_curated_table_prunes_and_round_trips(spark, tmp_path):
    whole = spark.createDataFrame(
        [*drifting_house(house=0), *drifting_house(house=4, seed=3)], SCHEMA
    )
    path = str(tmp_path / "curated")
    ev.write_curated(whole, path)
    params = house_params()
    part = ev.read_curated(spark, path, *params.evaluation, house_id=4)
    want = whole.where(splits.inside(params.evaluation)).where("house_id = 4")
    assert part.exceptAll(want.select(*part.columns)).count() == 0
    assert part.count() == want.count()
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "house_id" in plan.split("PartitionFilters")[1]
    with pytest.raises(Exception, match="ALREADY_EXISTS|already exists"):
        ev.write_curated(whole, path)


def test_sinks_and_consolidation(spark, tmp_path):
    rows = spark.createDataFrame(
        [("m", "uniform", 0, 0, 0, 0.5, 7)],
        "source_group string, mode string, bound_violation_count bigint, "
        "suppression_violation_count bigint, budget_violation_count bigint, rmse double, "
        "valid_events bigint",
    )
    path = str(tmp_path / "report")
    sinks.write_report(rows, path)
    assert spark.read.option("header", True).csv(path).first().mode == "uniform"
    with pytest.raises(Exception, match="ALREADY_EXISTS|already exists"):
        sinks.write_report(rows, path)
    sinks.write_report(rows, path, overwrite=True)
    with pytest.raises(ValueError, match="flatten"):
        sinks.write_report(rows.withColumn("m", F.create_map("mode", "rmse")), path + "x")
    sinks.write_report(rows.withColumn("m", F.create_map("mode", "rmse")), path + "j", "json")
    for name in ("one", "two"):
        rows.withColumn("source_group", F.lit(name)).write.parquet(str(tmp_path / "runs" / name))
    read = sinks.read_runs(spark, str(tmp_path / "runs" / "*"))
    merged = sinks.consolidate(read, None)
    assert tuple(merged.columns) == sinks.CONSOLIDATED and len(merged.columns) == 46
    assert [r.source_group for r in merged.collect()] == ["one", "two"]
    assert all(r.safety_pass and r.prediction_rmse is None for r in merged.collect())
    drift = spark.createDataFrame(
        [(START + timedelta(hours=h), 0, 0, str(h)) for h in (3, 1, 2)],
        "timestamp timestamp, household_id bigint, plug_id bigint, event_id string",
    )
    sinks.write_table(drift, str(tmp_path / "out" / "drift_events"))
    shown = sinks.inspect(spark, str(tmp_path / "out"), "drift_events", 2).collect()
    assert [r.event_id for r in shown] == ["1", "2"]


def test_unreadable_timestamps_become_null(spark):
    from pyspark.sql import functions as F

    from bandwise.functions.time import to_utc

    for kind, cells in (("string", ["99999999999999999", "1e30", "nan", "x", "1378015200"]), ("bigint", [99999999999999999, 1378015200]), ("double", [1e30, float("nan"), 1378015200.0])):
        table = spark.createDataFrame([(c,) for c in cells], f"t {kind}")
        found = table.select(F.unix_seconds(to_utc("t", table.schema["t"].dataType)).alias("s")).collect()
        assert [r.s for r in found] == [None] * (len(cells) - 1) + [1378015200]


def test_house_without_warmup_is_an_error(spark):
    rows = [*drifting_house(house=0), *drifting_house(seed=11, house=5)]
    params = house_params()
    events = spark.createDataFrame(rows, SCHEMA)
    lone = events.where((F.col("house_id") == 0) | splits.inside(params.evaluation))
    report = {r.house_id: r.lacks_warmup for r in splits.split_report(lone, params).collect()}
    assert report == {0: False, 5: True}
    with pytest.raises(ValueError, match="1 houses have no warm-up events, the first is 5"):
        _ = Study(lone, params).houses


def test_equal_rows_of_a_csv_file_have_their_own_ids(spark, tmp_path):
    path = tmp_path / "events.csv"
    path.write_text("\n".join([HEADER, *["1377993600,2,1,2,1,0"] * 3]) + "\n")
    rows = ev.read_events(spark, str(path), "csv").collect()
    assert len({r.event_id for r in rows}) == len({r.row_id for r in rows}) == 3


def test_csv_row_numbers_do_not_depend_on_file_splits(spark, tmp_path):
    folder = tmp_path / "files"
    folder.mkdir()
    lines = [f"{1377993600 + i},{i % 5},1,{i},7,3" for i in range(400)]
    (folder / "b.csv").write_text("\n".join([HEADER, *lines[300:]]) + "\n")
    (folder / "a.csv").write_text("\n".join([HEADER, *lines[:150], "", *lines[150:300]]) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("700b", "2kb", "1mb"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            rows = ev.read_events(spark, str(folder), "csv").collect()
            got = {r.plug_id: r.row_id for r in rows}
            assert got == {i: i if i < 300 else (1 << 40) + i - 300 for i in range(400)}
            assert all(r.event_id == str(r.row_id) for r in rows)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_declared_timestamp_formats(spark):
    from bandwise.functions.time import to_utc

    table = spark.createDataFrame([("20130901",), ("2013-09-01",), (None,)], "t string")
    kind = table.schema["t"].dataType

    def read(pattern):
        stamp = F.unix_seconds(to_utc("t", kind, "seconds", pattern))
        return [r[0] for r in table.select(stamp).collect()]

    day = 1377993600
    assert read("yyyyMMdd") == [day, None, None]
    assert read("text")[1:] == [day, None]
    assert read("epoch") == [20130901, None, None]
    assert read(None) == [20130901, day, None]


def test_sorted_tables_keep_their_order_over_files(spark, tmp_path):
    rows = spark.range(5000).select(
        F.expr("timestamp'2013-09-01' + make_interval(0,0,0,0,0,0, pmod(hash(id), 900))").alias("timestamp"),
        F.expr("id % 3").alias("household_id"), F.expr("id % 7").alias("plug_id"),
        F.col("id").cast("string").alias("event_id"), F.expr("id % 2").alias("part"),
    )
    path = str(tmp_path / "table")
    sinks.write_table(rows.repartition(8), path, partition_by=["part"])

    def ordered():
        # within a partition the file names are in the order of the ranges
        found = spark.read.parquet(path).select(
            "part", "timestamp", "household_id", "plug_id", "event_id",
            F.col("_metadata.file_name").alias("name"), F.col("_metadata.row_index").alias("at"),
        ).collect()
        for part in (0, 1):
            read = sorted((r for r in found if r.part == part), key=lambda r: (r.name, r["at"]))
            keys = [(r.timestamp, r.household_id, r.plug_id, r.event_id) for r in read]
            assert keys == sorted(keys)
        return found

    assert len(ordered()) == 5000
    # replacing one partition leaves the other
    sinks.write_table(rows.where("part = 1 and id < 100"), path, partition_by=["part"], overwrite=True)
    found = ordered()
    assert len([r for r in found if r.part == 0]) == 2500
    assert len([r for r in found if r.part == 1]) == 50


def test_runs_of_all_formats_are_consolidated(spark, tmp_path):
    base = spark.createDataFrame(
        [("uniform", 0, 0, 0, 0.5)],
        "mode string, bound_violation_count bigint, suppression_violation_count bigint, "
        "budget_violation_count bigint, rmse double",
    )
    for fmt in sinks.REPORT_FORMATS:
        sinks.write_report(base, str(tmp_path / fmt / "one" / "summary"), fmt, one_file=True)
        sinks.write_report(
            base.withColumn("mae", F.lit(0.25)), str(tmp_path / fmt / "two" / "summary"), fmt
        )
        read = sinks.read_runs(spark, str(tmp_path / fmt / "*" / "summary"), fmt)
        merged = sinks.consolidate(read, None).collect()
        assert [(r.source_group, r.mae, r.rmse) for r in merged] == [("one", None, 0.5), ("two", 0.25, 0.5)]
        assert all(r.safety_pass for r in merged)
        assert all(r.source_path.endswith(f"{r.source_group}/summary") for r in merged)
    with pytest.raises(ValueError, match="unknown report format"):
        sinks.read_runs(spark, str(tmp_path / "*"), "orc")


def test_coverage_is_judged_per_house(spark):
    rows = [*drifting_house(house=0), *drifting_house(seed=11, house=5)]
    events = spark.createDataFrame(rows, SCHEMA)
    params = house_params(
        validation=interval(START + timedelta(days=1), START + timedelta(hours=35, minutes=59)),
        evaluation=interval(START + timedelta(hours=36), START + timedelta(hours=47, minutes=45)),
    )
    splits.check_splits(events, params)
    late = events.where((F.col("house_id") == 0) | (F.col("timestamp") > F.lit(START)))
    with pytest.raises(ValueError, match="starts after warm-up start in 1 houses, the first is 5"):
        splits.check_splits(late, params)
    splits.check_splits(late, params, timedelta(minutes=15))
    short = events.where((F.col("house_id") == 5) | (F.col("timestamp") < F.lit(params.evaluation[1])))
    with pytest.raises(ValueError, match="ends before evaluation end in 1 houses, the first is 0"):
        splits.check_splits(short, params)
