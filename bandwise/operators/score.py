"""Rolling second moment of the last W residuals, as sums over blocks of W.

The residuals of a plug are numbered, and every W numbers are a block.  The last W of them are the
end of one block and the beginning of the next, so their sum is a suffix sum plus a prefix sum:
nothing is ever subtracted, and no window holds more than W rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from bandwise.operators.cycles import SLICE, brought_along
from bandwise.params import Params
from bandwise.sources.events import PLUG


def score_expression(total: Column, count: Column, floor: Column) -> Column:
    """Root mean square, at least the floor; the floor if there is no history."""
    moment = F.when(count > 0, total / count)
    return F.greatest(F.coalesce(F.sqrt(moment), floor), floor)


def numbered(residuals: DataFrame, states: DataFrame) -> DataFrame:
    """Number ``m`` of every residual of a plug, counted inside its slice and carried between them.

    ``residuals`` has the slice key, event order and ``sq`` (warm-up tail as cycle -1).
    """
    carried = states.select(*SLICE, (F.col("n_upto") - F.col("n")).alias("_carry"))
    local = Window.partitionBy(*SLICE).orderBy("ts_us", "row_id")
    inside = residuals.where(F.col("sq").isNotNull()).select(
        *SLICE, "sq", F.row_number().over(local).cast("bigint").alias("_offset")
    )
    return inside.join(carried, SLICE).select(
        *PLUG, (F.col("_carry") + F.col("_offset")).alias("m"), "sq"
    )


def window_sums(residuals: DataFrame, states: DataFrame, window: int) -> DataFrame:
    """Sum of the last ``window`` squares up to every residual: plug key, ``m`` and ``total``."""
    rows = numbered(residuals, states).withColumn("_block", F.expr(f"(m - 1) div {window}"))
    upto = Window.partitionBy(*PLUG, "_block").orderBy("m")
    onward = Window.partitionBy(*PLUG, "_block").orderBy(F.desc("m"))
    rows = rows.select(
        *PLUG, "m", F.sum("sq").over(upto).alias("_head"), F.sum("sq").over(onward).alias("_rest")
    )
    ends = rows.select(*PLUG, "m", "_head", F.lit(None).cast("double").alias("_rest"))
    # the suffix from a block's second number on is what a window ending in the next block takes
    begins = rows.where(F.col("m") % window != 1 % window).select(
        *PLUG, (F.col("m") + window - 1).alias("m"), F.lit(None).cast("double").alias("_head"), "_rest"
    )
    both = ends.unionByName(begins).groupBy(*PLUG, "m")
    return (
        both.agg(F.max("_head").alias("_head"), F.max("_rest").alias("_rest"))
        .where(F.col("_head").isNotNull())
        .select(*PLUG, "m", (F.col("_head") + F.coalesce("_rest", F.lit(0.0))).alias("total"))
    )


def scores_at_ticks(
    active: DataFrame,
    states: DataFrame,
    residuals: DataFrame,
    params: Params,
) -> DataFrame:
    """Score of every active plug at every tick: last ``window`` squares up to the tick.

    ``active`` brings ``sigma_floor`` (and whatever else rides with the states) along.
    """
    numbers = active.withColumn("m", F.col("n_upto"))
    sums = window_sums(residuals, states, params.window)
    joined = numbers.join(sums, [*PLUG, "m"], "left")
    return joined.select(
        "house_id",
        "cycle",
        "tick_us",
        "household_id",
        "plug_id",
        "last_us",
        *brought_along(states),
        score_expression(
            F.col("total"), F.least(F.col("n_upto"), F.lit(params.window)), F.col("sigma_floor")
        ).alias("score"),
    )


def scores_at_events(
    events: DataFrame,
    states: DataFrame,
    residuals: DataFrame,
    params: Params,
) -> DataFrame:
    """Add ``residual_score``: the score each event meets, from rows strictly before its batch."""
    carried = states.where(F.col("cycle") >= 0).select(
        *SLICE, (F.col("n_upto") - F.col("n")).alias("_n_carry")
    )
    earlier = (
        Window.partitionBy(*SLICE).orderBy("ts_us").rangeBetween(Window.unboundedPreceding, -1)
    )
    placed = events.join(carried, SLICE).withColumn(
        "m", F.col("_n_carry") + F.coalesce(F.count("sq").over(earlier), F.lit(0))
    )
    sums = window_sums(residuals, states, params.window)
    joined = placed.join(sums, [*PLUG, "m"], "left")
    return joined.withColumn(
        "residual_score",
        score_expression(
            F.col("total"), F.least(F.col("m"), F.lit(params.window)), F.col("sigma_floor")
        ),
    ).drop("_n_carry", "m", "total")
