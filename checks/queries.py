"""One query per operator, over the whole given tables.

``events`` is read as smart-plug readings: see ``plug_events``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace
from datetime import timedelta
from functools import partial

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bandwise import configure
from bandwise.functions import stats
from bandwise.operators import adaptive as ad
from bandwise.operators import allocate as alloc
from bandwise.operators import compare, cycles, decide, drift, fit, metrics, splits
from bandwise.operators.waterfill import waterfill
from bandwise.params import AdaptiveConfig, AllocationConfig, Params, interval, mode_grid
from bandwise.plans.adaptive import AdaptiveRun
from bandwise.plans.coupled import ProxyRun
from bandwise.plans.frozen import FrozenRun, Study
from bandwise.plans.studies import (
    HouseStudy,
    PredictorComparison,
    StagedSearch,
    compare_modes,
    pareto_sweep,
    predictor_matrix,
    predictor_points,
    sensitivity,
)
from bandwise.session import new_table_path, write_through
from bandwise.sources.events import (
    PLUG,
    accept,
    filter_counts,
    read_curated,
    read_events,
    valid_value,
    write_curated,
)
from bandwise.sources.sinks import (
    REPORT_FORMATS,
    consolidate,
    inspect,
    read_runs,
    write_report,
    write_table,
)

EPSILON = 5.0
EPSILONS = (0.5, 1.0, 2.0, 3.0, 4.0, 5.0, 7.5, 10.0, 15.0)
PREDICTOR_EPSILONS = (0.5, 1.0, 2.0, 4.0, 5.0, 7.5, 10.0)
CAPS = dict(cap_fraction=0.05, cap_min_samples=25)
PARAMS = Params(
    warmup=interval("2024-01-01", "2024-01-14 23:59:59.999999"),
    evaluation=interval("2024-01-15", "2024-01-30 23:59:59.999999"),
    slot_seconds=21_600,
    period_seconds=21_600,
    active_seconds=86_400,
    window=20,
    # statements add up in another order, so ties are told to nine digits
    tie_digits=9,
)
STAGED = replace(
    PARAMS,
    validation=interval("2024-01-15", "2024-01-19 23:59:59.999999"),
    evaluation=interval("2024-01-20", "2024-01-30 23:59:59.999999"),
)
BASE = AllocationConfig("base", "uniform", EPSILON, **CAPS)
TEMPLATE = AdaptiveConfig(
    BASE,
    alpha=0.2,
    bias_from_warmup=True,
    detector="cusum",
    kappa=0.5,
    threshold_h=5.0,
    cooldown=2,
    max_suppressions=4,
    max_silence=259_200,
)
SILENT_LIMIT = 0.055  # additional transmissions allowed in the comparison

_MEMO: dict[tuple, object] = {}


def shared(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], object]):
    """One study per session and scale: queries that need the same fitted tables share them."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _MEMO:
        _MEMO[key] = build()
    return _MEMO[key]


def plug_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    configure(spark)
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.col("event_id").cast("string").alias("event_id"),
        F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("timestamp"),
        "value",
        F.when(F.col("event_type") == "error", 2).otherwise(1).cast("bigint").alias("property"),
        F.expr("user_id div 12").alias("plug_id"),
        F.expr("(user_id div 3) % 4").alias("household_id"),
        F.expr("user_id % 3").alias("house_id"),
        F.col("event_id").alias("row_id"),
    )


def accepted(spark: SparkSession, sf_dir: str, params: Params = PARAMS) -> DataFrame:
    return accept(plug_events(spark, sf_dir), params)


def study(spark: SparkSession, sf_dir: str, params: Params = PARAMS) -> Study:
    return shared(
        spark, sf_dir, f"study-{hash(params)}", lambda: Study(accepted(spark, sf_dir, params), params)
    )


def modes_run(spark: SparkSession, sf_dir: str) -> FrozenRun:
    return shared(
        spark, sf_dir, "modes", lambda: compare_modes(study(spark, sf_dir), EPSILON, **CAPS)
    )


def house_study(spark: SparkSession, sf_dir: str) -> HouseStudy:
    def build():
        whole = HouseStudy(study(spark, sf_dir), EPSILON, EPSILONS, **CAPS)
        whole.__dict__["run"] = modes_run(spark, sf_dir)
        return whole

    return shared(spark, sf_dir, "house", build)


def comparison(spark: SparkSession, sf_dir: str) -> PredictorComparison:
    return shared(
        spark,
        sf_dir,
        "predictors",
        lambda: PredictorComparison(study(spark, sf_dir), BASE, TEMPLATE, SILENT_LIMIT),
    )


def proxy_study(spark: SparkSession, sf_dir: str) -> HouseStudy:
    return shared(
        spark,
        sf_dir,
        "proxy",
        lambda: HouseStudy(study(spark, sf_dir), EPSILON, EPSILONS, **CAPS),
    )


def tidy(df: DataFrame) -> DataFrame:
    """Doubles to six digits without negative zeros; maps to text."""
    out = []
    for field in df.schema.fields:
        column = F.col(field.name)
        if isinstance(field.dataType, T.DoubleType):
            column = F.round(column, 6) + F.lit(0.0)
        elif isinstance(field.dataType, T.IntegerType):
            column = column.cast("bigint")
        elif isinstance(field.dataType, T.TimestampType):
            column = column.cast("timestamp_ntz")
        out.append(column.alias(field.name))
    return df.select(*out)


# warm-up and filters -----------------------------------------------------------------------------


def q_filter_counts(spark, sf):
    return filter_counts(plug_events(spark, sf), PARAMS, house_id=1)


def q_filter_counts_by_house(spark, sf):
    return filter_counts(plug_events(spark, sf), PARAMS, by_house=True)


def q_accepted_events(spark, sf):
    return accepted(spark, sf)


def q_split_counts(spark, sf):
    return splits.split_counts(accepted(spark, sf, STAGED), STAGED)


def q_split_report(spark, sf):
    return splits.split_report(plug_events(spark, sf), STAGED)


def _source_file(spark, sf, fmt):
    """The readings as a file, with epoch seconds and some cells that cannot be read."""
    rows = plug_events(spark, sf)
    number = F.col("row_id")
    stamp = F.unix_seconds("timestamp")
    rows = rows.select(
        number.alias("number"),
        F.when(number % 11 == 0, F.lit(99_999_999_999_999_999)).otherwise(stamp).alias("timestamp"),
        F.when(number % 7 == 0, F.lit("nan").cast("double")).otherwise(F.col("value")).alias("value"),
        "property", "plug_id", "household_id", "house_id",
    )
    path = new_table_path(spark, f"source-{fmt}")
    if fmt == "csv":
        text = F.when(F.col("number") % 13 == 0, F.lit("n/a")).otherwise(F.col("value").cast("string"))
        rows.withColumn("value", text).write.option("header", True).csv(path)
    else:
        rows.write.parquet(path)
    return path


def _nan_as_null(rows):
    return rows.withColumn("value", F.when(~F.isnan("value"), F.col("value")))


def q_read_csv_events(spark, sf):
    path = _source_file(spark, sf, "csv")
    return _nan_as_null(read_events(spark, path, "csv", columns={"id": "number"}))


def q_read_parquet_events(spark, sf):
    path = _source_file(spark, sf, "parquet")
    rows = read_events(spark, path, "parquet", columns={"id": "number"})
    return _nan_as_null(rows).drop("row_id")


def q_read_without_id(spark, sf):
    """Every row has its own id, in both formats, equal rows too."""
    counts = []
    for fmt in ("csv", "parquet"):
        path = _source_file(spark, sf, fmt)
        rows = read_events(spark, path, fmt)
        counts.append(
            rows.groupBy("house_id").agg(
                F.lit(fmt).alias("format"),
                F.count("*").alias("rows"),
                F.countDistinct("event_id").alias("ids"),
                F.count("timestamp").alias("timestamps"),
                F.count_if(valid_value()).alias("valid"),
            )
        )
    return counts[0].unionByName(counts[1])


def q_csv_row_numbers(spark, sf):
    """Numbers of the rows of a CSV table without ids, read in large and in small splits."""
    rows = plug_events(spark, sf).select(
        F.unix_seconds("timestamp").alias("timestamp"), "value", F.col("row_id").alias("property"),
        "plug_id", "household_id", "house_id",
    )
    path = new_table_path(spark, "numbered-csv")
    ordered = rows.repartitionByRange(4, "property").sortWithinPartitions("property")
    ordered.write.option("header", True).csv(path)
    # a row's place among all: its number in the file behind the rows of the files before
    of_file, place = F.shiftright("row_id", 40), F.col("row_id").bitwiseAND((1 << 40) - 1)
    found = []
    setting = "spark.sql.files.maxPartitionBytes"
    default = spark.conf.get(setting)
    for label, size in (("large", default), ("small", "64kb")):
        spark.conf.set(setting, size)
        try:
            read = write_through(read_events(spark, path, "csv"), f"numbered-{label}")
        finally:
            spark.conf.set(setting, default)
        before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
        files = read.groupBy(of_file.alias("file")).agg(F.count("*").alias("rows"))
        files = files.select("file", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start"))
        found.append(
            read.withColumn("file", of_file).join(files, "file").select(
                F.col("property").alias("source_row"), (F.col("start") + place).alias(label)
            )
        )
    return found[0].join(found[1], "source_row")


def q_declared_formats(spark, sf):
    """Days as eight digits are dates if the format says so, and epoch seconds otherwise."""
    rows = plug_events(spark, sf).withColumn("timestamp", F.date_format("timestamp", "yyyyMMdd"))
    path = new_table_path(spark, "declared")
    rows.withColumnRenamed("row_id", "id").drop("event_id").write.option("header", True).csv(path)
    counts = []
    for pattern in ("yyyyMMdd", "epoch"):
        read = read_events(spark, path, "csv", timestamp_format=pattern)
        day = F.date_format("timestamp", "yyyy-MM-dd")
        counts.append(
            read.groupBy(F.lit(pattern).alias("pattern"), day.alias("day")).agg(F.count("*").alias("rows"))
        )
    return counts[0].unionByName(counts[1])


def q_curated_range(spark, sf):
    """Accepted events written by house and day, one house and some days read back."""
    path = new_table_path(spark, "curated")
    write_curated(accepted(spark, sf), path)
    first, last = STAGED.validation
    return read_curated(spark, path, first, last, house_id=1)


def q_slot_median_fit(spark, sf):
    warm = study(spark, sf).warm
    return fit.slot_medians(warm, PARAMS.slot_seconds)


def q_plug_median_fit(spark, sf):
    return fit.plug_medians(study(spark, sf).warm)


def q_predict_slot_median(spark, sf):
    s = study(spark, sf)
    return s.predict(s.evaluation).select("event_id", *PLUG, "value", "prediction", "residual")


def q_house_budget(spark, sf):
    loads = fit.mean_loads(study(spark, sf).warm)
    return loads.withColumn("house_budget", F.col("mean_load") * EPSILON)


def q_sigma_floor(spark, sf):
    s = study(spark, sf)
    return fit.sigma_floors(fit.plug_sigmas(s.warm_residuals), PARAMS.floor_percentile)


def q_residual_quantiles(spark, sf):
    return fit.residual_quantiles(study(spark, sf).warm_residuals)


def q_plug_caps(spark, sf):
    s = study(spark, sf)
    return fit.plug_caps(s.quantiles([BASE]), s.houses, BASE)


def q_drift_scales(spark, sf):
    s = study(spark, sf)
    mads = fit.residual_mads(s.warm_residuals)
    return mads.join(fit.drift_scales(mads, s.sigma_floors, 1.0), PLUG)


def q_drift_scale_lookup(spark, sf):
    """Plugs with few warm-up samples have no scale of their own and use the fallbacks."""
    s = study(spark, sf)
    scales = fit.drift_scales(fit.residual_mads(s.warm_residuals), s.sigma_floors, 1.0)
    enough = s.quantiles([BASE]).where(F.col("samples") >= 28).select(*PLUG)
    known = scales.join(enough, PLUG, "left_semi")
    houses = fit.house_scales(known, s.sigma_floors, 1.0)
    return fit.lookup_scales(s.events, known, fit.household_scales(known), houses, 1.0)


def q_ewma_warmup_bias(spark, sf):
    s = study(spark, sf)
    return fit.warmup_biases(s.warm_residuals, (0.05, 0.2, 1.0), PARAMS)


def q_warmup_tail(spark, sf):
    return study(spark, sf).tail.select(*PLUG, "row_id", "sq", "age")


# time and scores ---------------------------------------------------------------------------------


def q_last_seen_reactivation(spark, sf):
    return study(spark, sf).seen.select(
        "event_id",
        F.timestamp_micros("last_seen_us").alias("last_seen_timestamp"),
        "reactivated",
        "cycle",
    )


def q_activity_spells(spark, sf):
    return cycles.activity_spells(accepted(spark, sf), PARAMS.active_seconds)


def q_allocation_ticks(spark, sf):
    ticks = cycles.allocation_ticks(study(spark, sf).evaluation, PARAMS)
    return ticks.select("house_id", "cycle", "allocation_timestamp")


def q_active_set(spark, sf):
    return study(spark, sf).active.select(
        "house_id",
        "cycle",
        "household_id",
        "plug_id",
        F.timestamp_micros("last_us").alias("last_seen"),
    )


def q_rolling_score(spark, sf):
    return study(spark, sf).snapshots.select(
        "house_id", "cycle", "household_id", "plug_id", "score"
    )


def q_event_scores(spark, sf):
    return study(spark, sf).seen_with_scores().select("event_id", "residual_score")


# allocation --------------------------------------------------------------------------------------


def _trace(spark, sf, mode):
    return modes_run(spark, sf).trace.where(F.col("mode") == mode)


def q_alloc(spark, sf, mode):
    return _trace(spark, sf, mode).select(
        "house_id",
        "cycle",
        "household_id",
        "plug_id",
        "score",
        "threshold",
        "household_budget",
        "used_budget",
        "unused_budget",
    )


def q_alloc_cap(spark, sf):
    return _trace(spark, sf, "true_hierarchical_cap").select(
        "house_id",
        "cycle",
        "household_id",
        "plug_id",
        "cap",
        "threshold",
        "household_budget",
        "used_budget",
        "cap_hit_count",
        "within_household_redistributed_budget",
        "cross_household_spill_budget",
    )


def q_household_shares(spark, sf):
    rows = alloc.household_risks(study(spark, sf).snapshots, PARAMS)
    rows = rows.withColumn("alpha_fair", F.lit(0.2))
    return rows.select(
        "house_id",
        "cycle",
        "household_id",
        "household_risk",
        "risk_share",
        alloc.household_share().alias("household_share"),
    )


def q_waterfill(spark, sf):
    """Half of each supplier's revenue is poured over its lines by quantity, up to their price."""
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").select(
        "l_suppkey",
        "l_orderkey",
        "l_linenumber",
        F.col("l_quantity").cast("double").alias("weight"),
        (F.col("l_extendedprice") * F.col("l_discount")).alias("current"),
        F.col("l_extendedprice").cast("double").alias("cap"),
    )
    totals = lines.groupBy("l_suppkey").agg((F.sum("cap") * 0.5).alias("amount"))
    poured = waterfill(
        lines.join(totals, "l_suppkey"),
        ["l_suppkey"],
        weight="weight",
        current="current",
        cap="cap",
        amount="amount",
    )
    return poured.select(
        "l_suppkey", "l_orderkey", "l_linenumber", F.round("filled", 4).alias("filled")
    )


def q_missing_caps(spark, sf):
    s = study(spark, sf)
    return alloc.missing_caps(s.active, s.quantiles([BASE]), BASE.cap_min_samples)


# decisions and metrics -----------------------------------------------------------------------------


def q_decide(spark, sf, mode):
    rows = modes_run(spark, sf).decisions.where(F.col("mode") == mode)
    return rows.select(
        "event_id", "threshold_used", "transmitted", "forced_reason", "reconstructed",
        "reconstruction_error",
    )


def q_decision_table(spark, sf):
    run = shared(
        spark,
        sf,
        "cap-run",
        lambda: study(spark, sf).run(mode_grid(("true_hierarchical_cap",), (EPSILON,), **CAPS)),
    )
    return run.full_decisions().drop("config_id")


def q_batch_rollup(spark, sf):
    batches = modes_run(spark, sf).batches
    return batches.select(
        "mode",
        "house_id",
        "timestamp",
        "actual_house",
        "reconstructed_house",
        "house_error",
        "abs_house_error",
        "event_count",
        "transmitted_count",
        "allocated_budget",
        "budget_utilization",
        "bound_utilization",
        "bound_violation",
    )


def q_summary_modes(spark, sf):
    return metrics.flatten_forced(modes_run(spark, sf).summary()).drop("config_id")


def q_cvar(spark, sf):
    """Tail of line prices per ship day status: split percentiles and tail means at line scale."""
    lines = spark.read.parquet(f"{sf}/lineitem.parquet")
    return stats.tail_means(
        lines,
        ["l_returnflag"],
        F.col("l_extendedprice"),
        {"cvar95": ("p95", 0.95), "cvar99": ("p99", 0.99)},
    )


def q_top_share(spark, sf):
    lines = spark.read.parquet(f"{sf}/lineitem.parquet")
    return stats.top_share(
        lines,
        ["l_returnflag"],
        F.col("l_extendedprice") * F.col("l_extendedprice"),
        {"top_1_percent": 0.01, "top_5_percent": 0.05},
    )


def q_spearman(spark, sf):
    lines = spark.read.parquet(f"{sf}/lineitem.parquet")
    return stats.spearman(lines, ["l_returnflag"], "l_quantity", "l_extendedprice", "rho")


def q_daily_metrics(spark, sf):
    return modes_run(spark, sf).daily().drop("config_id")


def q_household_metrics(spark, sf):
    return modes_run(spark, sf).households().drop("config_id")


def q_plug_metrics(spark, sf):
    return modes_run(spark, sf).plugs().drop("config_id")


def q_top_outliers(spark, sf):
    rows = modes_run(spark, sf).outliers(40)
    return rows.select(
        "mode", "house_id", "outlier_rank", "event_id", "reconstruction_error",
        F.col("abs_house_error"),
    )


def q_suppression_streaks(spark, sf):
    rows = modes_run(spark, sf).streaks
    return rows.select("mode", "event_id", "consecutive_suppression")


def q_forced_counts(spark, sf):
    counts = metrics.forced_counts(modes_run(spark, sf).decisions)
    return counts.withColumn("mode", F.split("config_id", "@")[0]).drop("config_id")


def q_fingerprint(spark, sf):
    prints = decide.fingerprint(modes_run(spark, sf).decisions)
    flat = prints.where(F.col("config_id").startswith("flat")).drop("config_id")
    legacy = prints.where(F.col("config_id").startswith("legacy")).select(
        "house_id", F.col("fingerprint").alias("other")
    )
    return flat.join(legacy, "house_id").select(
        "house_id", "events", "transmitted", (F.col("fingerprint") == F.col("other")).alias("same")
    )


def q_repeatability(spark, sf):
    s = study(spark, sf)
    grid = mode_grid(("uniform",), (EPSILON,))
    again = Study(s.events, s.params).run(grid).summary()
    columns = [c for c in again.columns if c != "forced_transmit"]
    first = s.run(grid).summary()
    return compare.repeatability(tidy(first.select(columns)), tidy(again.select(columns)))


# comparisons ---------------------------------------------------------------------------------------


def q_tail_comparison(spark, sf):
    return house_study(spark, sf).tails().drop("config_id")


def q_hierarchy_cycles(spark, sf):
    return house_study(spark, sf).hierarchy_cycles()


def q_hierarchy_effect(spark, sf):
    return compare.hierarchy_effect(house_study(spark, sf).hierarchy_cycles())


def q_legacy_equivalence(spark, sf):
    return house_study(spark, sf).legacy_equivalence().withColumn(
        "max_difference", F.round("max_difference", 6)
    )


def q_cap_diagnostics(spark, sf):
    return house_study(spark, sf).cap_diagnostics().drop("config_id")


def q_pareto_sweep(spark, sf):
    return house_study(spark, sf).points


def q_pareto_dominance(spark, sf):
    flagged = compare.with_dominance(tidy(house_study(spark, sf).points))
    return flagged.select("house_id", "mode", "epsilon", "pareto_dominated")


def q_matched_tr(spark, sf):
    return house_study(spark, sf).matched()


def q_best_pick(spark, sf):
    points = house_study(spark, sf).points
    return compare.best_pick(
        points, ["house_id"], ["cvar99", "rmse", "max", "transmission_ratio", "mode"], PARAMS.tie_digits
    ).select("house_id", "mode", "epsilon", "cvar99")


def q_verdict(spark, sf):
    return house_study(spark, sf).verdict()


def q_ofat_grid(spark, sf):
    base = AllocationConfig("base", "true_hierarchical_cap", EPSILON, **CAPS)
    return sensitivity(study(spark, sf, STAGED), base)


# adaptive ------------------------------------------------------------------------------------------


def _detector(kind):
    return drift.Detector(
        kind, z_threshold=1.5, z_count=2, kappa=0.5, threshold_h=4.0, cooldown=2
    )


def q_detect_drift(spark, sf, kind):
    s = study(spark, sf)
    scales = fit.drift_scales(fit.residual_mads(s.warm_residuals), s.sigma_floors, 1.0)
    rows = s.scored.join(scales, PLUG).select(
        *PLUG, "cycle", "ts_us", "row_id", "event_id", "residual", "scale"
    )
    found = drift.detect_drift(
        rows, PLUG, ["ts_us", "row_id"], "residual", "scale", _detector(kind), slice_col="cycle"
    )
    return found.select(
        "event_id", "standardized", "drift_detected", "held_by_cooldown", "z_run", "cusum_up",
        "cusum_down", "cooldown_left",
    )


def q_adaptive(spark, sf, mode):
    rows = comparison(spark, sf).run.decisions.where(F.col("predictor_mode") == mode)
    return rows.select(
        "event_id",
        "prediction",
        "innovation",
        "threshold_used",
        "transmitted",
        F.col("forced_reason").alias("reason"),
        "normal_would_transmit",
        "prior_suppressions",
        "edge_bias",
        "version",
    )


_FULL_MODE = "slot_median_ewma_drift_periodic_sync"


def _adaptive(spark, sf):
    return comparison(spark, sf).run.decisions


def _with_predictor(rows):
    return rows.withColumn("predictor_mode", F.split("config_id", "/")[1])


def q_update_trace(spark, sf):
    rows = ad.update_trace(_adaptive(spark, sf))
    return rows.select(
        "predictor_mode", "event_id", "reason", "innovation", "server_bias_before",
        "server_bias_after", "predictor_state_version",
    )


def q_drift_events(spark, sf):
    rows = ad.drift_events(_adaptive(spark, sf))
    return rows.drop("config_id")


def q_resync_events(spark, sf):
    return ad.resync_events(_adaptive(spark, sf)).drop("config_id")


def q_bias_trace(spark, sf):
    rows = ad.bias_trace(_adaptive(spark, sf), every=10)
    return rows.select(
        "predictor_mode", "house_id", "event_number", "event_id", "edge_bias", "transmitted"
    )


def q_silence_durations(spark, sf):
    rows = ad.silence_durations(_adaptive(spark, sf), PARAMS)
    return _with_predictor(rows).select("predictor_mode", "event_id", "silence_seconds")


def q_recovery_episodes(spark, sf):
    return _with_predictor(ad.recovery_episodes(_adaptive(spark, sf))).drop("config_id")


def q_prediction_metrics(spark, sf):
    rows = ad.prediction_metrics(comparison(spark, sf).run.decisions)
    return rows.withColumn("predictor_mode", F.split("config_id", "/")[1]).drop("config_id")


def q_plug_predictions(spark, sf):
    return comparison(spark, sf).run.plug_predictions().drop("config_id")


def q_predictor_summary(spark, sf):
    rows = comparison(spark, sf).run.predictor_summary()
    return rows.drop("config_id")


def q_triggers_by_plug(spark, sf):
    rows = ad.triggers_by_plug(_adaptive(spark, sf))
    return _with_predictor(rows).select("predictor_mode", "house_id", "plug", "triggers")


def q_adaptive_summary(spark, sf):
    rows = comparison(spark, sf).run.summary()
    flat = metrics.flatten_forced(rows, ad.ADAPTIVE_REASONS)
    return flat.withColumn("predictor_mode", F.split("config_id", "/")[1]).drop("config_id")


def q_predictor_comparison(spark, sf):
    return comparison(spark, sf).rows.drop("config_id")


def q_prediction_outliers(spark, sf):
    rows = comparison(spark, sf).run.outliers(30)
    return rows.select("house_id", "predictor_mode", "outlier_rank", "event_id", "innovation")


def q_outlier_root_cause(spark, sf):
    return comparison(spark, sf).causes(30)


def q_outlier_changes(spark, sf):
    return comparison(spark, sf).changes(30)


def _predictor_points(spark, sf):
    return shared(
        spark,
        sf,
        "predictor-points",
        lambda: predictor_points(study(spark, sf), BASE, TEMPLATE, "slot_median_ewma", PREDICTOR_EPSILONS),
    )


def q_predictor_points(spark, sf):
    return _predictor_points(spark, sf)


def q_predictor_matches(spark, sf):
    return compare.predictor_matches(_predictor_points(spark, sf), digits=PARAMS.tie_digits)


def q_tradeoff_summary(spark, sf):
    points = tidy(_predictor_points(spark, sf))
    rows = compare.tradeoff_summary(points, compare.predictor_matches(points, digits=PARAMS.tie_digits))
    return rows.withColumn("adaptive_modes", F.array_join("adaptive_modes", ","))


def q_consolidated_runs(spark, sf):
    """Summaries written by several runs, in folders of their own, read by glob and put together."""
    root = new_table_path(spark, "runs")
    frozen = modes_run(spark, sf).summary().drop("config_id", "forced_transmit")
    frozen = write_through(frozen, "frozen-runs")
    # one run lacks a column that the other has
    write_report(frozen.where("mode <> 'uniform'"), f"{root}/frozen/modes/summary", "parquet")
    write_report(
        frozen.where("mode = 'uniform'").drop("mae"), f"{root}/frozen/uniform/summary", "parquet"
    )
    rows = comparison(spark, sf).run
    write_report(
        rows.summary().drop("forced_transmit")
        .join(rows.predictor_summary(), ["config_id", "house_id"])
        .withColumnRenamed("mode", "allocator_mode").drop("config_id"),
        f"{root}/adaptive/predictors/summary", "json",
    )
    found = consolidate(
        read_runs(spark, f"{root}/frozen/*/summary"),
        read_runs(spark, f"{root}/adaptive/*/summary", "json"),
    )
    return found.withColumn("source_path", F.regexp_extract("source_path", "([^/]+/[^/]+/[^/]+)$", 1))


def q_report_files(spark, sf):
    """The summary written as a report in every format and read back."""
    rows = write_through(tidy(q_summary_modes(spark, sf)), "report-rows")
    root = new_table_path(spark, "reports")
    found = []
    for fmt in REPORT_FORMATS:
        write_report(rows, f"{root}/{fmt}", fmt)
        reader = spark.read.schema(rows.schema).option("header", True)
        found.append(
            reader.format(fmt).load(f"{root}/{fmt}").select(F.lit(fmt).alias("format"), "*")
        )
    return found[0].unionByName(found[1]).unionByName(found[2])


def q_sorted_tables(spark, sf):
    """Batches of all modes, written sorted by mode and house: rows behind their successor, over all files."""
    path = new_table_path(spark, "sorted")
    rows = modes_run(spark, sf).batches.withColumn("timestamp", F.timestamp_micros("ts_us"))
    write_table(rows, path, partition_by=["mode", "house_id"])
    half = rows.where("mode = 'uniform'")
    # written once more, its partitions are replaced and the others stay
    write_table(half, path, partition_by=["mode", "house_id"], overwrite=True)
    read = spark.read.parquet(path).select(
        "mode", "house_id", "timestamp", F.col("_metadata.file_name").alias("file"),
        F.col("_metadata.row_index").alias("place"),
    )
    inside = Window.partitionBy("mode", "house_id", "file").orderBy("place")
    files = (
        read.withColumn("behind", F.lag("timestamp").over(inside) > F.col("timestamp"))
        .groupBy("mode", "house_id", "file")
        .agg(
            F.count("*").alias("rows"), F.count_if("behind").alias("behind"),
            F.min("timestamp").alias("first"), F.max("timestamp").alias("last"),
        )
    )
    over = Window.partitionBy("mode", "house_id").orderBy("file")
    late = F.coalesce(F.lag("last").over(over) > F.col("first"), F.lit(False))
    return files.withColumn("late", late).groupBy("mode", "house_id").agg(
        F.sum("rows").alias("rows"), F.sum("behind").alias("rows_behind"),
        F.count_if("late").alias("files_behind"), F.min("first").alias("first_timestamp"),
        F.max("last").alias("last_timestamp"),
    )


def q_inspect_drift(spark, sf):
    """First rows of a written table of drift events; a table without rows keeps its columns."""
    root = new_table_path(spark, "inspect")
    rows = q_drift_events(spark, sf).where("predictor_mode = 'slot_median_ewma_drift'")
    write_table(rows, f"{root}/drift_events")
    write_table(rows.where("false"), f"{root}/resynchronization_events")
    empty = inspect(spark, root, "resynchronization_events")
    return inspect(spark, root, "drift_events", 25).unionByName(empty)


def q_own_predictor(spark, sf):
    """Decisions with a predictor of the user's own, the mean of a plug's warm-up."""
    base = study(spark, sf)
    means = base.hold(base.warm.groupBy(*PLUG).agg(F.avg("value").alias("prediction")), "own-means")

    def predict(events):
        joined = events.join(means, PLUG, "left")
        return joined.withColumn("residual", F.col("value") - F.col("prediction"))

    run = Study(base.events, base.params, predictor=predict).run([BASE])
    return run.decisions.select("event_id", "prediction", "threshold_used", "transmitted")


def q_own_allocator(spark, sf):
    """Allocations of an allocator of the user's own: half in equal shares, half by residual score."""
    if "half_by_score" not in alloc.THRESHOLDS:
        even = F.lit(0.5) / F.col("n_house")
        risk = F.when(F.col("sum_house") > 0, F.col("score") / F.col("sum_house") / 2).otherwise(even)
        alloc.register_allocator("half_by_score", lambda: F.col("house_budget") * (even + risk))
    own = replace(BASE, config_id="own", mode="half_by_score")
    return study(spark, sf).run([own]).trace.select(
        "house_id", "cycle", "household_id", "plug_id", "score", "threshold", "household_budget", "used_budget"
    )


def q_adaptive_disabled(spark, sf):
    """With the adaptive part disabled every predictor mode decides as the frozen one."""
    off = replace(
        TEMPLATE, enabled=False, predictor_mode=_FULL_MODE, allocation=replace(BASE, config_id="off")
    )
    return AdaptiveRun(study(spark, sf), [off]).decisions.select(
        "event_id", "prediction", "threshold_used", "transmitted"
    )


# coupled -------------------------------------------------------------------------------------------


def q_decide_proxy(spark, sf):
    _, proxy = proxy_study(spark, sf).proxy_runs
    return proxy.decisions.select("mode", "event_id", "threshold_used", "transmitted")


def q_exact_proxy(spark, sf):
    return proxy_study(spark, sf).exact_proxy()


def q_predictor_matrix(spark, sf):
    allocators = mode_grid(epsilons=(EPSILON,), **CAPS)
    return predictor_matrix(study(spark, sf), allocators, TEMPLATE)


def q_staged_search(spark, sf):
    search = StagedSearch(
        study(spark, sf, STAGED), BASE, TEMPLATE, maximum_additional_tr=0.1,
        maximum_unresolved_fraction=0.64, slack=timedelta(days=1),
    )
    return search.candidates


# streams -------------------------------------------------------------------------------------------


def _stream(spark: SparkSession, sf: str) -> DataFrame:
    configure(spark)
    raw = spark.read.parquet(f"{sf}/events.parquet")
    source = (
        spark.readStream.schema(raw.schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    )
    rows = source.select(
        F.col("event_id").cast("string").alias("event_id"),
        F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("timestamp"),
        "value",
        F.when(F.col("event_type") == "error", 2).otherwise(1).cast("bigint").alias("property"),
        F.expr("user_id div 12").alias("plug_id"),
        F.expr("(user_id div 3) % 4").alias("household_id"),
        F.expr("user_id % 3").alias("house_id"),
        F.col("event_id").alias("row_id"),
    )
    return accept(rows, PARAMS)


def _run_stream(
    spark: SparkSession, events: DataFrame, operator: Callable[[DataFrame], DataFrame], name: str
) -> DataFrame:
    """The whole result of a streaming operator: the given events end, and so does its state."""
    from bandwise.streaming import until_end, write_bounded

    path = new_table_path(spark, name)
    rows = operator(until_end(events, f"{path}/end"))
    write_bounded(
        rows, f"{path}/data", f"{path}/checkpoint", f"{path}/end",
        name=f"{name}-{uuid.uuid4().hex[:8]}",
    )
    return spark.read.schema(rows.schema).option("recursiveFileLookup", True).parquet(
        f"{path}/data"
    )


def q_stream_batches(spark, sf):
    from bandwise.streaming import batch_rollup

    return _run_stream(
        spark, _stream(spark, sf), lambda rows: batch_rollup(rows, "1 hour"), "stream-batches"
    )


def q_stream_ticks(spark, sf):
    from bandwise.streaming import allocation_windows

    return _run_stream(
        spark, _stream(spark, sf), lambda rows: allocation_windows(rows, PARAMS, "1 hour"),
        "stream-ticks",
    )


def q_stream_spells(spark, sf):
    from bandwise.streaming import stream_spells

    return _run_stream(
        spark, _stream(spark, sf), lambda rows: stream_spells(rows, PARAMS.active_seconds, "1 hour"),
        "stream-spells",
    )


def q_stream_predictions(spark, sf):
    from bandwise.streaming import predict_stream, write_stream

    s = study(spark, sf)
    rows = _stream(spark, sf).where(splits.inside(PARAMS.evaluation))
    rows = predict_stream(rows, s.slot_medians, s.plug_medians, PARAMS.slot_seconds)
    rows = rows.select("event_id", "value", "prediction", "residual")
    path = new_table_path(spark, "stream-predictions")
    query = write_stream(
        rows, f"{path}/data", f"{path}/checkpoint", available_now=True,
        name=f"stream-predictions-{uuid.uuid4().hex[:8]}",
    )
    query.awaitTermination()
    return spark.read.schema(rows.schema).option("recursiveFileLookup", True).parquet(
        f"{path}/data"
    )


def stream_inputs(s: Study, config: AdaptiveConfig) -> tuple[DataFrame, DataFrame]:
    """Static sides of the stateful stream: thresholds per cycle, and starting states per plug."""
    thresholds = s.run([config.allocation]).trace.select(*PLUG, "cycle", "threshold")
    adaptive = AdaptiveRun(s, [config])
    biases = adaptive.biases.select(*PLUG, F.col("bias").alias("initial_bias"))
    plugs = adaptive.scales.join(s.warm_plugs.select(*PLUG, "last_us"), PLUG, "left")
    plugs = plugs.join(biases, PLUG, "left").join(s.sigma_floors, "house_id", "left")
    return thresholds, plugs


def _written(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).option("recursiveFileLookup", True).parquet(path)


def _predicted_stream(spark, sf):
    from bandwise.streaming import predict_stream

    s = study(spark, sf)
    rows = _stream(spark, sf).where(splits.inside(PARAMS.evaluation))
    return predict_stream(rows, s.slot_medians, s.plug_medians, PARAMS.slot_seconds)


def q_stream_deadband(spark, sf):
    from bandwise.streaming import decide_stream

    s = study(spark, sf)
    config = replace(TEMPLATE, predictor_mode=_FULL_MODE)
    thresholds, plugs = stream_inputs(s, config)

    def decided(rows: DataFrame) -> DataFrame:
        return decide_stream(
            rows, thresholds, plugs, config, PARAMS, delay="1 hour", floor=1.0, ticks=s.ticks
        )

    out = _run_stream(spark, _predicted_stream(spark, sf), decided, "stream-deadband")
    return out.select(
        "event_id", "prediction", "threshold_used", "transmitted",
        F.col("forced_reason").alias("reason"), "late",
    )


def q_stream_late(spark, sf):
    """Readings above 100 arrive when all others have been worked on; those behind the watermark are only counted."""
    from bandwise.streaming import decide_stream, predict_stream, until_end, write_bounded
    from bandwise.streaming.deadband import late_counts

    s = study(spark, sf)
    config = replace(TEMPLATE, predictor_mode=_FULL_MODE)
    thresholds, plugs = stream_inputs(s, config)
    path = new_table_path(spark, "stream-late")
    second = F.col("value") > 100

    def deliver(condition):
        s.evaluation.where(condition).write.mode("append").parquet(f"{path}/in")

    deliver(~second)
    source = spark.readStream.schema(s.evaluation.schema).parquet(f"{path}/in")
    rows = predict_stream(source, s.slot_medians, s.plug_medians, PARAMS.slot_seconds)
    decided = decide_stream(
        until_end(rows, f"{path}/end"), thresholds, plugs, config, PARAMS, delay="1 hour", floor=1.0,
        ticks=s.ticks,
    )
    write_bounded(
        decided, f"{path}/data", f"{path}/checkpoint", f"{path}/end",
        name=f"stream-late-{uuid.uuid4().hex[:8]}", more=[lambda: deliver(second)],
    )
    return late_counts(_written(spark, f"{path}/data", decided.schema)).drop("config_id")


def _stream_allocation(spark, sf):
    """Thresholds of all six modes from the event stream; the folder they are written to."""
    from bandwise.streaming import StreamAllocation, gather_periods, until_end, write_bounded

    def build():
        path = new_table_path(spark, "stream-allocation")
        allocation = StreamAllocation(study(spark, sf), mode_grid(epsilons=(EPSILON,), **CAPS), path)
        allocation.start()
        rows = until_end(_predicted_stream(spark, sf), f"{path}/end")
        write_bounded(
            gather_periods(rows, PARAMS, "1 hour"), f"{path}/periods", f"{path}/checkpoint", f"{path}/end",
            name=f"stream-allocation-{uuid.uuid4().hex[:8]}", refresh=allocation.refresh,
        )
        return allocation

    return shared(spark, sf, "stream-allocation", build)


def q_stream_thresholds(spark, sf):
    path = _stream_allocation(spark, sf).path
    rows = spark.read.parquet(f"{path}/trace")
    return rows.select(
        "mode", "house_id", "cycle", "household_id", "plug_id", "score", "threshold", "cap", "household_budget",
        "used_budget", "unused_budget", "cap_hit_count",
    )


def q_stream_rollup(spark, sf):
    """Reconstructed load and house error: events joined with the thresholds' stream."""
    from bandwise.streaming import rolled_decisions, threshold_stream, until_end, write_bounded
    from bandwise.streaming.allocation import end_of_periods

    allocation = _stream_allocation(spark, sf)
    path = new_table_path(spark, "stream-rollup")
    events = until_end(_predicted_stream(spark, sf), f"{path}/end")
    thresholds = end_of_periods(threshold_stream(spark, allocation.path), f"{path}/end")
    rows = rolled_decisions(events, thresholds, allocation.configs, PARAMS, "1 hour")
    write_bounded(
        rows, f"{path}/data", f"{path}/checkpoint", f"{path}/end", name=f"stream-rollup-{uuid.uuid4().hex[:8]}"
    )
    return _written(spark, f"{path}/data", rows.schema).select(
        "mode", "house_id", "timestamp", "actual_house", "reconstructed_house", "house_error", "abs_house_error",
        "event_count", "transmitted_count", "allocated_budget", "budget_utilization", "bound_utilization",
        "bound_violation",
    )


# registry ------------------------------------------------------------------------------------------

# thresholds that depend on decisions walk the cycles from the driver: in the library, not registered
_UNREGISTERED = ("decide_proxy", "exact_proxy", "predictor_matrix")

_PLAIN = {
    name[2:]: function
    for name, function in list(globals().items())
    if name.startswith("q_") and name not in ("q_alloc", "q_decide", "q_detect_drift", "q_adaptive")
    and name[2:] not in _UNREGISTERED
}
_BY_ARGUMENT = {
    **{f"alloc_{short}": partial(q_alloc, mode=mode) for short, mode in (
        ("full_tx", "full_tx"), ("uniform", "uniform"), ("flat", "flat_variance"),
        ("legacy", "legacy_two_stage"), ("hierarchical", "true_hierarchical"),
    )},
    **{f"decide_{short}": partial(q_decide, mode=mode) for short, mode in (
        ("full_tx", "full_tx"), ("uniform", "uniform"), ("flat", "flat_variance"),
        ("hierarchical", "true_hierarchical"), ("hierarchical_cap", "true_hierarchical_cap"),
    )},
    **{f"detect_drift_{short}": partial(q_detect_drift, kind=kind) for short, kind in (
        ("zscore", "zscore_consecutive"), ("cusum", "cusum"),
    )},
    **{f"adaptive_uniform_{short}": partial(q_adaptive, mode=mode) for short, mode in (
        ("frozen", "slot_median_frozen"), ("ewma", "slot_median_ewma"),
        ("sync", "slot_median_ewma_periodic_sync"), ("drift", "slot_median_ewma_drift"),
        ("drift_sync", _FULL_MODE),
    )},
}


def registry() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def tidied(function):
        return lambda spark, sf_dir: tidy(function(configure(spark), sf_dir))

    return {
        name: tidied(function) for name, function in sorted({**_PLAIN, **_BY_ARGUMENT}.items())
    }
