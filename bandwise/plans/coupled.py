"""Runs in which a cycle's thresholds depend on the decisions of the cycle before.

The plugs of a house meet only once per cycle, when the budget is divided.  So the study walks
the cycles in order, and inside a cycle every plug of every house and configuration is decided in
parallel with the ordinary operators.  Between cycles only the last W squares per plug are
carried, in two tables of the shared folder that take turns.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from bandwise.operators import allocate as alloc
from bandwise.operators import decide, score
from bandwise.operators.adaptive import KEY, ORDER, SCHEMA, STATE, adaptive_walk
from bandwise.operators.fold import end_states, fold_slice
from bandwise.params import AdaptiveConfig, AllocationConfig
from bandwise.plans.frozen import FrozenRun, Study
from bandwise.session import new_table_path, write_through
from bandwise.sources.events import PLUG

ESTIMATORS = ("exact", "uniform_proxy")


def per_config(rows: DataFrame, configs: Sequence[AllocationConfig]) -> DataFrame:
    """Repeat rows for the configuration ids of a (bounded) grid."""
    ids = F.array(*[F.lit(c.config_id) for c in configs])
    return rows.select(F.explode(ids).alias("config_id"), "*")


def observed_square(estimator: str, residual: str) -> Column:
    """What a decided event adds to its plug's window; nothing without a prediction.

    The proxy does not know a suppressed residual and takes the variance of a uniform one.
    """
    square = F.col(residual) * F.col(residual)
    if estimator == "uniform_proxy":
        unknown = F.col("threshold_used") * F.col("threshold_used") / F.lit(3.0)
        square = F.when(F.col("transmitted"), square).otherwise(unknown)
    return F.when(F.col(residual).isNotNull(), square)


def first_windows(study: Study, configs: Sequence[AllocationConfig]) -> DataFrame:
    """Window of every plug after the warm-up, oldest square first (at most W entries)."""
    entries = F.array_sort(F.collect_list(F.struct((-F.col("age")).alias("place"), "sq")))
    arrays = study.tail.groupBy(*PLUG).agg(
        F.transform(entries, lambda e: e["sq"]).alias("recent")
    )
    return per_config(arrays, configs)


def moved_windows(windows: DataFrame, decided: DataFrame, window: int) -> DataFrame:
    """Windows after a cycle: a plug's newest W squares."""
    newest = Window.partitionBy(*KEY).orderBy(F.desc("ts_us"), F.desc("row_id"))
    fresh = (
        decided.where(F.col("pushed").isNotNull())
        .withColumn("_age", F.row_number().over(newest))
        .where(F.col("_age") <= window)
        .groupBy(*KEY)
        .agg(
            F.transform(
                F.array_sort(F.collect_list(F.struct((-F.col("_age")).alias("place"), "pushed"))),
                lambda e: e["pushed"],
            ).alias("fresh")
        )
    )
    none = F.array().cast("array<double>")
    both = F.concat(F.coalesce("recent", none), F.coalesce("fresh", none))
    return (
        windows.join(fresh, KEY, "full_outer")
        .withColumn("_both", both)
        .select(
            *KEY,
            F.slice(
                F.col("_both"), F.greatest(F.size("_both") - window, F.lit(0)) + 1, F.lit(window)
            ).alias("recent"),
        )
    )


def window_scores(
    active: DataFrame, windows: DataFrame, configs: Sequence[AllocationConfig]
) -> DataFrame:
    total = F.aggregate("recent", F.lit(0.0), lambda a, x: a + x)
    joined = (
        per_config(
            active.select(
                "house_id", "cycle", "tick_us", "household_id", "plug_id", "mean_load",
                "sigma_floor",
            ),
            configs,
        )
        .join(windows, KEY, "left")
    )
    return joined.withColumn(
        "score",
        score.score_expression(
            F.coalesce(total, F.lit(0.0)),
            F.coalesce(F.size("recent"), F.lit(0)),
            F.col("sigma_floor"),
        ),
    ).drop("recent")


class Coupled:
    """Walks the cycles once for a grid of configurations; afterwards everything is a table."""

    def __init__(
        self,
        study: Study,
        configs: Sequence[AllocationConfig],
        estimator: str = "uniform_proxy",
        predictors: Sequence[AdaptiveConfig] | None = None,
        seen: DataFrame | None = None,
    ):
        if estimator not in ESTIMATORS:
            raise ValueError(f"unknown estimator: {estimator}")
        self.study = study
        self.configs = list(configs)
        self.estimator = estimator
        self.predictors = list(predictors) if predictors else None
        self.seen = study.seen if seen is None else seen

    def walk(self, adaptive_rows=None) -> tuple[DataFrame, DataFrame | None]:
        """Trace and, with predictors, the folded decisions of all cycles.

        ``adaptive_rows`` turns thresholded events into input rows of the adaptive fold.
        """
        study, configs = self.study, self.configs
        spark = study.events.sparkSession
        active = write_through(study.active, "active", partition_by="cycle")
        events = write_through(self.seen, "seen", partition_by="cycle")
        capped = any(c.mode == "true_hierarchical_cap" for c in configs)
        quantiles = study.quantiles(configs) if capped else None
        trace_root, fold_root = new_table_path(spark, "trace"), new_table_path(spark, "fold")
        turns = [new_table_path(spark, "window"), new_table_path(spark, "window")]
        windows = first_windows(study, configs)
        state = None
        trace_schema = decided = None
        last_cycle = int(study.ticks.agg(F.max("cycle")).first()[0])
        for cycle in range(last_cycle + 1):
            scored = window_scores(active.where(F.col("cycle") == cycle), windows, configs)
            trace = alloc.allocate(scored, None, quantiles, configs, study.params)
            trace_schema = trace.schema
            trace.write.parquet(f"{trace_root}/part={cycle}")
            trace = spark.read.schema(trace_schema).parquet(f"{trace_root}/part={cycle}")
            rows = decide.with_thresholds(
                events.where(F.col("cycle") == cycle), trace, configs
            )
            if self.predictors is None:
                decided = decide.decide(rows)
                residual = "residual"
            else:
                step = adaptive_walk(self.predictors, study.params)
                folded = fold_slice(adaptive_rows(rows), state, KEY, ORDER, step, SCHEMA, STATE)
                folded.write.parquet(f"{fold_root}/part={cycle}")
                decided = spark.read.schema(SCHEMA).parquet(f"{fold_root}/part={cycle}")
                state = write_through(end_states(decided, state, KEY, ORDER, STATE), "fold-state")
                residual = "residual"
            if cycle < last_cycle:
                pushed = decided.withColumn("pushed", observed_square(self.estimator, residual))
                turn = turns[cycle % 2]
                moved = moved_windows(windows, pushed, study.params.window)
                moved.write.mode("overwrite").parquet(turn)
                windows = spark.read.schema(moved.schema).parquet(turn)
        trace = spark.read.schema(trace_schema).option("recursiveFileLookup", True)
        trace = trace.parquet(trace_root)
        if self.predictors is None:
            return trace, None
        folded = spark.read.schema(SCHEMA).option("recursiveFileLookup", True)
        return trace, folded.parquet(fold_root)


class ProxyRun(FrozenRun):
    """A frozen run whose scores see only what the receiver can know."""

    @cached_property
    def trace(self) -> DataFrame:
        return Coupled(self.study, self.configs, "uniform_proxy").walk()[0]

    @cached_property
    def budgets(self) -> DataFrame:
        return alloc.cycle_budgets(self.trace)

    def _thresholded(self, events: DataFrame) -> DataFrame:
        return decide.with_thresholds(events, self.trace, self.configs)
