"""Allocation instants, the time slices between them, last-seen times and active sets.

A cycle is the time between two allocations of a house, open at its start and closed at its end:
events of cycle ``c`` obey the allocation made at tick ``c``, and tick ``c + 1`` sees exactly the
events of all cycles up to ``c``.  Everything per event is sliced by (house, cycle), so a large
house is spread over as many tasks as it has cycles, and the strict as-of join of events to
allocations becomes an equi join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from bandwise.params import Params
from bandwise.session import spread
from bandwise.sources.events import PLUG

SLICE = ["house_id", "cycle", "household_id", "plug_id"]
SLICE_TOTALS = ["last_us", "n", "prev_last_us", "next_cycle", "n_upto"]


def period_cell(params: Params) -> Column:
    elapsed = F.col("ts_us") - F.lit(params.start_us)
    return F.floor(elapsed / F.lit(params.period_us)).cast("bigint")


def with_micros(events: DataFrame) -> DataFrame:
    return events.withColumn("ts_us", F.unix_micros("timestamp"))


def allocation_ticks(evaluation: DataFrame, params: Params) -> DataFrame:
    """First batch of every non-empty period after the first, plus one tick before the start."""
    firsts = (
        with_micros(evaluation)
        .withColumn("cell", period_cell(params))
        .groupBy("house_id", "cell")
        .agg(F.min("ts_us").alias("first_us"))
    )
    initial = firsts.groupBy("house_id").agg(
        F.lit(0).cast("bigint").alias("cell"), F.lit(params.start_us - 1).alias("tick_us")
    )
    later = firsts.where(F.col("cell") >= 1).select(
        "house_id", "cell", F.col("first_us").alias("tick_us")
    )
    numbered = Window.partitionBy("house_id").orderBy("cell")
    return initial.unionByName(later).select(
        "house_id",
        "cell",
        "tick_us",
        (F.row_number().over(numbered) - 1).cast("bigint").alias("cycle"),
        F.timestamp_micros("tick_us").alias("allocation_timestamp"),
    )


def assign_cycle(evaluation: DataFrame, ticks: DataFrame, params: Params) -> DataFrame:
    """Cycle whose allocation governs the event: the newest tick strictly before it."""
    cells = ticks.select("house_id", "cell", "tick_us", F.col("cycle").alias("_cell_cycle"))
    events = with_micros(evaluation).withColumn("cell", period_cell(params))
    joined = events.join(cells, ["house_id", "cell"])
    strictly_after = F.col("ts_us") > F.col("tick_us")
    return joined.withColumn(
        "cycle", F.col("_cell_cycle") - F.when(strictly_after, F.lit(0)).otherwise(F.lit(1))
    ).drop("cell", "tick_us", "_cell_cycle")


def by_slice(events: DataFrame) -> DataFrame:
    """The one exchange of the events: later windows, joins and batch sums stay inside it."""
    return spread(events, "house_id", "cycle")


def slice_states(events: DataFrame, warm_plugs: DataFrame) -> DataFrame:
    """One row per plug and cycle with events (cycle -1 is the warm-up) and running totals.

    ``warm_plugs`` has ``last_us`` and, for the score, ``n`` of the warm-up tail, and ``cycle`` if what came before is not the warm-up.  The windows run over a plug's cycles, not
    over its events.
    """
    cycle = F.col("cycle") if "cycle" in warm_plugs.columns else F.lit(-1).cast("bigint")
    current = events.groupBy(*SLICE).agg(
        F.max("ts_us").alias("last_us"),
        F.count("sq").alias("n"),
    )
    before = warm_plugs.select(
        "house_id",
        cycle.alias("cycle"),
        "household_id",
        "plug_id",
        "last_us",
        F.coalesce(F.col("n"), F.lit(0)).cast("bigint").alias("n"),
    )
    order = Window.partitionBy(*PLUG).orderBy("cycle")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return current.unionByName(before).select(
        *SLICE,
        "last_us",
        "n",
        F.lag("last_us").over(order).alias("prev_last_us"),
        F.lead("cycle").over(order).alias("next_cycle"),
        F.sum("n").over(upto).alias("n_upto"),
    )


def brought_along(states: DataFrame) -> list[str]:
    """Columns of a state table beyond its own: house or plug figures that ride with the slices.

    Events, snapshots and scores get them from the join they need anyway, so no event-sized table
    is ever joined (and shuffled) by house or by plug alone.
    """
    return [c for c in states.columns if c not in SLICE and c not in SLICE_TOTALS]


def active_sets(states: DataFrame, ticks: DataFrame, params: Params) -> DataFrame:
    """Plugs whose last event lies in ``(tick - T, tick]``, with the slice that was their last.

    A slice is a plug's newest one for the cycles up to its next slice; an event can keep a plug
    active for at most T / P + 2 ticks, so every slice is repeated a bounded number of times and
    then meets its ticks in an equi join.
    """
    reach = params.active_us // params.period_us + 2
    last = F.least(
        F.coalesce(F.col("next_cycle"), F.col("cycle") + F.lit(reach)),
        F.col("cycle") + F.lit(reach),
    )
    candidates = states.select(
        *PLUG,
        F.col("cycle").alias("from_cycle"),
        "last_us",
        "n_upto",
        *brought_along(states),
        F.explode(F.sequence(F.col("cycle") + 1, last)).alias("cycle"),
    )
    joined = candidates.join(
        ticks.select("house_id", "cycle", "tick_us"), ["house_id", "cycle"]
    )
    return joined.where(F.col("last_us") > F.col("tick_us") - F.lit(params.active_us))


def with_last_seen(events: DataFrame, states: DataFrame, params: Params) -> DataFrame:
    """Previous last-seen time strictly before the batch, and the reactivation flag."""
    carried = states.where(F.col("cycle") >= 0).select(
        *SLICE, "prev_last_us", *brought_along(states)
    )
    earlier = (
        Window.partitionBy(*SLICE)
        .orderBy("ts_us")
        .rangeBetween(Window.unboundedPreceding, -1)
    )
    seen = F.coalesce(F.max("ts_us").over(earlier), F.col("prev_last_us"))
    return (
        events.join(carried, SLICE)
        .withColumn("last_seen_us", seen)
        .withColumn(
            "reactivated",
            F.col("last_seen_us").isNull()
            | (F.col("ts_us") - F.col("last_seen_us") > F.lit(params.active_us)),
        )
        .drop("prev_last_us")
    )


def activity_spells(events: DataFrame, gap_seconds: int, slice_seconds: int = 86_400) -> DataFrame:
    """Maximal runs of a plug's events with no gap above ``gap_seconds``.

    Distinct times are taken first and gaps are found inside fixed time slices with a carry, so
    no plug is sorted as a whole; spells themselves are then a plain aggregate.
    """
    from bandwise.functions.stats import running_totals

    slice_us, gap_us = slice_seconds * 1_000_000, gap_seconds * 1_000_000
    times = (
        with_micros(events)
        .groupBy(*PLUG, "ts_us")
        .agg(F.count("*").alias("events"))
        .withColumn("_slice", F.floor(F.col("ts_us") / F.lit(slice_us)).cast("bigint"))
    )
    edges = times.groupBy(*PLUG, "_slice").agg(F.max("ts_us").alias("_last"))
    along = Window.partitionBy(*PLUG).orderBy("_slice")
    edges = edges.select(*PLUG, "_slice", F.lag("_last").over(along).alias("_carry"))
    local = Window.partitionBy(*PLUG, "_slice").orderBy("ts_us")
    marked = times.join(edges, [*PLUG, "_slice"]).withColumn(
        "_prev", F.coalesce(F.lag("ts_us").over(local), F.col("_carry"))
    )
    starts = F.when(
        F.col("_prev").isNull() | (F.col("ts_us") - F.col("_prev") > F.lit(gap_us)), F.lit(1)
    ).otherwise(F.lit(0))
    numbered = running_totals(
        marked.drop("_carry"), PLUG, "_slice", ["ts_us"], sums={"spell": starts}
    )
    return numbered.groupBy(*PLUG, "spell").agg(
        F.timestamp_micros(F.min("ts_us")).alias("spell_start"),
        F.timestamp_micros(F.max("ts_us")).alias("spell_end"),
        F.sum("events").alias("events"),
    )
