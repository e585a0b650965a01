"""Warm-up statistics: seasonal medians, budgets, residual scales, caps, starting states."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from bandwise.functions.stats import exact_percentiles
from bandwise.functions.time import slot_of, weekday_of
from bandwise.params import AllocationConfig, Params
from bandwise.sources.events import PLUG

SLOT = ["weekday", "slot"]
# Normal-consistency factor of the median absolute deviation, reported quantiles.
MAD_FACTOR = 1.4826
BASE_QUANTILES = (0.90, 0.95, 0.99)


def with_slot(events: DataFrame, slot_seconds: int) -> DataFrame:
    stamp = F.col("timestamp")
    return events.withColumn("weekday", weekday_of(stamp)).withColumn(
        "slot", slot_of(stamp, slot_seconds)
    )


def slot_medians(warm: DataFrame, slot_seconds: int) -> DataFrame:
    return exact_percentiles(
        with_slot(warm, slot_seconds), [*PLUG, *SLOT], F.col("value"), {"slot_median": 0.5},
    )


def plug_medians(warm: DataFrame) -> DataFrame:
    return exact_percentiles(warm, PLUG, F.col("value"), {"plug_median": 0.5})


def predict(
    events: DataFrame, slots: DataFrame, plugs: DataFrame, slot_seconds: int
) -> DataFrame:
    """Seasonal prediction: slot median, else plug median, else null; and the residual.

    Both sides are joined by key; Spark broadcasts a fitted table only while it is small.
    """
    joined = (
        with_slot(events, slot_seconds)
        .join(slots, [*PLUG, *SLOT], "left")
        .join(plugs, PLUG, "left")
    )
    return joined.withColumn("prediction", F.coalesce("slot_median", "plug_median")).withColumn(
        "residual", F.col("value") - F.col("prediction")
    ).drop("slot_median", "plug_median", *SLOT)


def house_loads(warm: DataFrame) -> DataFrame:
    return warm.groupBy("house_id", "timestamp").agg(F.sum("value").alias("house_load"))


def mean_loads(warm: DataFrame) -> DataFrame:
    return house_loads(warm).groupBy("house_id").agg(F.avg("house_load").alias("mean_load"))


def last_seen(warm: DataFrame) -> DataFrame:
    return warm.groupBy(*PLUG).agg(F.max("timestamp").alias("last_seen"))


def plug_sigmas(residuals: DataFrame) -> DataFrame:
    return residuals.groupBy(*PLUG).agg(
        F.sqrt(F.avg(F.col("residual") * F.col("residual"))).alias("sigma")
    )


def sigma_floors(
    sigmas: DataFrame, floor_percentile: float) -> DataFrame:
    """Percentile of the positive plug sigmas per house, 1.0 for a house without any."""
    positive = exact_percentiles(
        sigmas.where(F.col("sigma") > 0),
        ["house_id"],
        F.col("sigma"),
        {"positive_floor": floor_percentile / 100.0},
    )
    return (
        sigmas.select("house_id")
        .distinct()
        .join(positive, "house_id", "left")
        .select("house_id", F.coalesce("positive_floor", F.lit(1.0)).alias("sigma_floor"))
    )


def quantile_name(p: float) -> str:
    return f"q{p:g}".replace(".", "_")


def residual_quantiles(
    residuals: DataFrame, probs: Sequence[float] = BASE_QUANTILES) -> DataFrame:
    """Sample count and quantiles of the absolute warm-up residual per plug."""
    wanted = {quantile_name(p): p for p in sorted({*BASE_QUANTILES, *probs})}
    counts = residuals.groupBy(*PLUG).agg(F.count("*").alias("samples"))
    values = exact_percentiles(residuals, PLUG, F.abs("residual"), wanted)
    return counts.join(values, PLUG, "left")


def plug_caps(
    quantiles: DataFrame, houses: DataFrame, config: AllocationConfig
) -> DataFrame:
    """Cap per plug for one configuration; needs ``mean_load`` and ``sigma_floor`` per house."""
    return quantiles.join(houses, "house_id").select(
        *PLUG,
        cap_expression(
            F.lit(config.epsilon) * F.col("mean_load"),
            F.col(quantile_name(config.cap_quantile)),
            F.lit(config.cap_fraction),
            F.lit(config.cap_multiplier),
            F.lit(config.cap_min_samples),
        ).alias("cap"),
    )


def cap_expression(
    budget: Column, quantile: Column, fraction: Column, multiplier: Column, min_samples: Column
) -> Column:
    limit = fraction * budget
    enough = F.coalesce(F.col("samples"), F.lit(0)) >= min_samples
    return F.when(
        enough, F.least(limit, F.greatest(multiplier * quantile, F.col("sigma_floor")))
    ).otherwise(limit)


def residual_medians(residuals: DataFrame) -> DataFrame:
    return exact_percentiles(
        residuals, PLUG, F.col("residual"), {"residual_median": 0.5}
    )


def residual_mads(residuals: DataFrame) -> DataFrame:
    """Median absolute deviation from the plug's own residual median."""
    centred = residuals.join(residual_medians(residuals), PLUG, "left")
    return exact_percentiles(
        centred, PLUG, F.abs(F.col("residual") - F.col("residual_median")), {"mad": 0.5},
    )


def drift_scales(mads: DataFrame, floors: DataFrame, min_scale: float) -> DataFrame:
    return mads.join(floors, "house_id").select(
        *PLUG,
        F.greatest(
            F.col("mad") * F.lit(MAD_FACTOR), F.col("sigma_floor"), F.lit(float(min_scale))
        ).alias("scale"),
    )


def household_scales(scales: DataFrame) -> DataFrame:
    return exact_percentiles(
        scales, ["house_id", "household_id"], F.col("scale"), {"household_scale": 0.5}
    )


def house_scales(
    scales: DataFrame, floors: DataFrame, min_scale: float) -> DataFrame:
    medians = exact_percentiles(
        scales, ["house_id"], F.col("scale"), {"median_scale": 0.5}
    )
    fallback = F.greatest(F.col("sigma_floor"), F.lit(float(min_scale)), F.lit(1.0))
    return floors.join(medians, "house_id", "left").select(
        "house_id", "sigma_floor", F.coalesce("median_scale", fallback).alias("house_scale")
    )


def lookup_scales(
    plugs: DataFrame,
    scales: DataFrame,
    households: DataFrame,
    houses: DataFrame,
    min_scale: float,
) -> DataFrame:
    """First positive of plug, household, house scale, sigma floor and 1, never under min_scale."""
    joined = (
        plugs.select(*PLUG)
        .distinct()
        .join(scales, PLUG, "left")
        .join(households, ["house_id", "household_id"], "left")
        .join(houses, "house_id", "left")
    )

    def positive(name: str) -> Column:
        return F.when(F.col(name) > 0, F.col(name))

    first = F.coalesce(
        positive("scale"),
        positive("household_scale"),
        positive("house_scale"),
        positive("sigma_floor"),
        F.lit(1.0),
    )
    return joined.select(
        *PLUG, F.greatest(first, F.lit(float(min_scale))).alias("robust_scale")
    )


def warmup_tail(residuals: DataFrame, window: int, params: Params) -> DataFrame:
    """Squares of the last ``window`` residuals per plug.

    Periods are counted first, so only the rows of each plug's newest periods that are needed to
    reach ``window`` are ranked; a long history is never sorted as one group.
    """
    rows = residuals.where(F.col("residual").isNotNull()).select(
        *PLUG,
        F.unix_micros("timestamp").alias("ts_us"),
        "row_id",
        (F.col("residual") * F.col("residual")).alias("sq"),
    )
    rows = rows.withColumn(
        "_period", F.floor(F.col("ts_us") / F.lit(params.period_us)).cast("bigint")
    )
    newer = Window.partitionBy(*PLUG).orderBy(F.desc("_period"))
    counts = (
        rows.groupBy(*PLUG, "_period")
        .agg(F.count("*").alias("_c"))
        .withColumn(
            "_after",
            F.coalesce(
                F.sum("_c").over(newer.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
            ),
        )
        .where(F.col("_after") < F.lit(window))
        .select(*PLUG, "_period", "_after")
    )
    newest = Window.partitionBy(*PLUG, "_period").orderBy(F.desc("ts_us"), F.desc("row_id"))
    return (
        rows.join(counts, [*PLUG, "_period"])
        .withColumn("_rank", F.row_number().over(newest) + F.col("_after"))
        .where(F.col("_rank") <= F.lit(window))
        .select(*PLUG, "ts_us", "row_id", "sq", F.col("_rank").cast("int").alias("age"))
    )


def warmup_biases(residuals: DataFrame, alphas: Sequence[float], params: Params) -> DataFrame:
    """EWMA bias after the warm-up, for every alpha, by its closed form.

    A residual that ``k`` later residuals follow has weight ``alpha * (1 - alpha) ** k``; ``k``
    is the rank inside the period plus the count of the plug's later periods.
    """
    rows = residuals.where(F.col("residual").isNotNull()).select(
        *PLUG, F.unix_micros("timestamp").alias("ts_us"), "row_id", "residual"
    )
    rows = rows.withColumn(
        "_period", F.floor(F.col("ts_us") / F.lit(params.period_us)).cast("bigint")
    )
    newest = Window.partitionBy(*PLUG, "_period").orderBy(F.desc("ts_us"), F.desc("row_id"))
    ranked = rows.withColumn("_k", F.row_number().over(newest) - 1)

    def weight(alpha: float, k: str) -> Column:
        if alpha == 1.0:
            return F.when(F.col(k) == 0, F.lit(1.0)).otherwise(F.lit(0.0))
        return F.pow(F.lit(1.0 - alpha), F.col(k))

    names = {alpha: f"_bias_{i}" for i, alpha in enumerate(dict.fromkeys(alphas))}
    later = Window.partitionBy(*PLUG).orderBy(F.desc("_period"))
    periods = (
        ranked.groupBy(*PLUG, "_period")
        .agg(
            F.count("*").alias("_c"),
            *[
                F.sum(F.lit(alpha) * weight(alpha, "_k") * F.col("residual")).alias(name)
                for alpha, name in names.items()
            ],
        )
        .withColumn(
            "_after",
            F.coalesce(
                F.sum("_c").over(later.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
            ),
        )
    )
    wide = periods.groupBy(*PLUG).agg(
        *[
            F.sum(weight(alpha, "_after") * F.col(name)).alias(name)
            for alpha, name in names.items()
        ]
    )
    pairs = [
        F.struct(F.lit(float(alpha)).alias("alpha"), F.col(name).alias("bias"))
        for alpha, name in names.items()
    ]
    return wide.select(*PLUG, F.inline(F.array(*pairs)))
