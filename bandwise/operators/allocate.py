"""Division of a house's error budget over its active plugs at every tick.

An allocator takes rows keyed by (house_id, cycle, household_id, plug_id) with ``score`` and adds
``threshold``.  What it needs of a household or a house are sums over its plugs, taken with partial
sums and joined back, and water levels; no task holds all plugs of a house or household at a tick.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bandwise.functions.stats import coarse, exact_percentiles, unit_of
from bandwise.operators.fit import cap_expression, quantile_name
from bandwise.operators.waterfill import water_levels
from bandwise.params import KNOWN_MODES, AllocationConfig, Params
from bandwise.session import write_through
from bandwise.sources.events import PLUG

TICK = ["house_id", "cycle"]
CAPPED = "true_hierarchical_cap"
TRACE_COLUMNS = [
    "config_id",
    "mode",
    "house_id",
    "cycle",
    "allocation_timestamp",
    "effective_after",
    "household_id",
    "plug_id",
    "score",
    "threshold",
    "cap",
    "household_budget",
    "house_budget",
    "used_budget",
    "unused_budget",
    "cap_hit_count",
    "within_household_redistributed_budget",
    "cross_household_spill_budget",
]

#: Totals of a household and a house at a tick that every trace row carries.
BOOKED = [
    "household_budget",
    "used_budget",
    "unused_budget",
    "cap_hit_count",
    "within_household_redistributed_budget",
    "cross_household_spill_budget",
]


def household_risks(snapshots: DataFrame, params: Params) -> DataFrame:
    """Per tick and household: aggregates of the scores, those of the house, and its share of the risk.

    Scores may differ between configurations; then the rows carry ``config_id``.
    """
    tick = _tick(snapshots)
    whole = coarse(F.col("score"), unit_of(F.col("sigma_floor")))
    households = snapshots.groupBy(*tick, "household_id").agg(
        F.count("*").alias("n_household"),
        F.sum(whole).alias("_coarse"),
        F.sum(F.col("score") - whole).alias("_fine"),
        F.avg("score").alias("mean_household"),
        F.max("score").alias("max_household"),
    )
    households = households.withColumn("sum_household", F.col("_coarse") + F.col("_fine"))
    households = write_through(households, "households")
    houses = households.groupBy(*tick).agg(
        F.sum("n_household").alias("n_house"),
        (F.sum("_coarse") + F.sum("_fine")).alias("sum_house"),
        F.count("*").alias("n_households"),
    )
    households = households.drop("_coarse", "_fine")
    medians = exact_percentiles(snapshots, tick, F.col("score"), {"median_house": 0.5})
    rows = households.join(houses, tick).join(medians, tick)
    rows = write_through(rows.withColumn("household_risk", risk_expression(params)), "risks")
    totals = rows.groupBy(*tick).agg(F.sum("household_risk").alias("_total"))
    share = F.when(F.col("_total") > 0, F.col("household_risk") / F.col("_total")).otherwise(
        F.lit(1.0) / F.col("n_households")
    )
    return rows.join(totals, tick).withColumn("risk_share", share).drop("_total")


def _tick(rows: DataFrame) -> list[str]:
    return ["config_id", *TICK] if "config_id" in rows.columns else TICK


def with_risk(snapshots: DataFrame, params: Params) -> DataFrame:
    """Snapshots with the figures of their household and house."""
    return snapshots.join(household_risks(snapshots, params), [*_tick(snapshots), "household_id"])


def risk_expression(params: Params) -> Column:
    """Mean, maximum and size term of a household; the size is scaled by the house's median."""
    return (
        F.lit(params.lambda_mean) * F.col("mean_household")
        + F.lit(params.lambda_max) * F.col("max_household")
        + F.lit(params.lambda_count) * F.log1p(F.col("n_household")) * F.col("median_house")
    )


def household_share() -> Column:
    """Equal shares mixed with risk shares."""
    alpha = F.col("alpha_fair")
    return alpha / F.col("n_households") + (F.lit(1.0) - alpha) * F.col("risk_share")


def plug_share() -> Column:
    """Share of a plug inside its household: equal shares mixed with score shares."""
    equal = F.lit(1.0) / F.col("n_household")
    by_score = F.when(
        F.col("sum_household") > 0, F.col("score") / F.col("sum_household")
    ).otherwise(equal)
    return F.col("beta") * equal + (F.lit(1.0) - F.col("beta")) * by_score


def _full_tx() -> Column:
    return F.lit(0.0)


def _uniform() -> Column:
    return F.col("house_budget") / F.col("n_house")


def _flat_variance() -> Column:
    return F.when(
        F.col("sum_house") > 0, F.col("house_budget") * F.col("score") / F.col("sum_house")
    ).otherwise(_uniform())


def _legacy_two_stage() -> Column:
    group_budget = F.col("house_budget") * F.col("sum_household") / F.col("sum_house")
    inside = F.when(
        F.col("sum_household") > 0, group_budget * F.col("score") / F.col("sum_household")
    ).otherwise(F.lit(0.0))
    return F.when(F.col("sum_house") > 0, inside).otherwise(_uniform())


def _true_hierarchical() -> Column:
    return F.col("house_budget") * household_share() * plug_share()


# Uncapped allocators by name: each is one column expression over the risk table.
THRESHOLDS: dict[str, Callable[[], Column]] = {
    "full_tx": _full_tx,
    "uniform": _uniform,
    "flat_variance": _flat_variance,
    "legacy_two_stage": _legacy_two_stage,
    "true_hierarchical": _true_hierarchical,
}


def register_allocator(name: str, threshold: Callable[[], Column]) -> None:
    """Add an uncapped allocator: an expression over the risk table and a configuration's columns."""
    if name in KNOWN_MODES:
        raise ValueError(f"allocator exists: {name}")
    KNOWN_MODES.add(name)
    THRESHOLDS[name] = threshold


def with_configs(
    rows: DataFrame, configs: Sequence[AllocationConfig], only: str | None = None
) -> DataFrame:
    """Repeat rows for a literal grid of configurations (bounded by the caller's grid), or those of one mode.

    Rows that carry ``config_id`` already belong to one configuration and only get its settings.
    """
    grid = F.array(
        *[
            F.struct(
                F.lit(i).alias("config_pos"),
                F.lit(c.config_id).alias("config_id"),
                F.lit(c.mode).alias("mode"),
                F.lit(float(c.epsilon)).alias("epsilon"),
                F.lit(float(c.alpha_fair)).alias("alpha_fair"),
                F.lit(float(c.beta)).alias("beta"),
                F.lit(quantile_name(c.cap_quantile)).alias("cap_quantile"),
                F.lit(float(c.cap_multiplier)).alias("cap_multiplier"),
                F.lit(float(c.cap_fraction)).alias("cap_fraction"),
                F.lit(int(c.cap_min_samples)).alias("cap_min_samples"),
            )
            for i, c in enumerate(configs)
            if only is None or c.mode == only
        ]
    )
    if "config_id" in rows.columns:
        rows = rows.withColumnRenamed("config_id", "_own_config")
        grid = F.filter(grid, lambda c: c["config_id"] == F.col("_own_config"))
    return rows.select("*", F.inline(grid)).drop("_own_config")


def allocate(
    snapshots: DataFrame,
    houses: DataFrame | None,
    quantiles: DataFrame | None,
    configs: Sequence[AllocationConfig],
    params: Params,
) -> DataFrame:
    """Threshold trace of a grid of configurations; see `Allocation`."""
    return Allocation(snapshots, houses, quantiles, configs, params).trace()


class Allocation:
    """Thresholds of a grid of configurations, packed: one row per active plug and tick for the whole grid.

    ``snapshots``: active plugs per tick with ``score`` and ``tick_us``; ``houses``: ``mean_load``
    and ``sigma_floor``, unless the snapshots bring them; ``quantiles``: warm-up residual quantiles, needed for caps only.

    A threshold is an expression over the figures of its plug, household and house and, with caps, the
    water level of the household.  So rows are repeated for the grid only where they are summed up or
    decided on, inside one stage: what is written and shuffled does not grow with the grid.
    """

    def __init__(
        self,
        snapshots: DataFrame,
        houses: DataFrame | None,
        quantiles: DataFrame | None,
        configs: Sequence[AllocationConfig],
        params: Params,
    ):
        unknown = {c.mode for c in configs} - KNOWN_MODES
        if unknown:
            raise ValueError(f"unknown mode: {sorted(unknown)}")
        self.configs, self.params = list(configs), params
        capped = [c for c in configs if c.mode == CAPPED]
        rows = snapshots
        if "mean_load" not in snapshots.columns:
            rows = snapshots.join(houses, "house_id")
        if capped:
            if quantiles is None:
                raise ValueError("true_hierarchical_cap needs residual quantiles")
            self._names = sorted({quantile_name(c.cap_quantile) for c in capped})
            rows = rows.join(quantiles.select(*PLUG, "samples", *self._names), PLUG, "left")
        rows = write_through(with_risk(rows, params), "risk-rows")
        self._tick = _tick(rows)
        self._kept = None
        if capped:
            levels, self._kept = self._levels(rows)
            rows = write_through(rows.join(levels, [*self._tick, "household_id"], "left"), "levelled")
        self.rows = rows
        self.households = self._household_sums()

    def _capped_rows(self, risks: DataFrame) -> DataFrame:
        """Rows repeated for the capped configurations, with cap and weight."""
        rows = with_configs(risks, self.configs, CAPPED)
        rows = rows.withColumn("house_budget", F.col("epsilon") * F.col("mean_load"))
        return rows.withColumns({"weight": plug_share(), "own_share": household_share(), "cap": self._cap()})

    def _cap(self) -> Column:
        chosen = F.lit(None).cast("double")
        for name in self._names:
            chosen = F.when(F.col("cap_quantile") == name, F.col(name)).otherwise(chosen)
        return cap_expression(
            F.col("house_budget"), chosen, F.col("cap_fraction"), F.col("cap_multiplier"), F.col("cap_min_samples")
        )

    def _levels(self, risks: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Water levels of the households under each capped configuration, and what the houses keep.

        Every household first spends what it can of its own budget; what is left in the house flows
        to households with room by pure risk share; a household then fills its plugs to one level.
        """
        key = ["config_id", *TICK]
        family = [*key, "household_id"]
        own = F.col("house_budget") * F.col("own_share")
        rows = self._capped_rows(risks).withColumn("own_budget", own)
        rows = rows.withColumn("clamped", F.least(F.col("own_budget") * F.col("weight"), F.col("cap")))
        # what a household keeps of its own budget, and its room beyond that
        kept = F.least("own_budget", "capacity")
        households = (
            rows.groupBy(*family)
            .agg(
                F.sum("cap").alias("capacity"), F.sum("clamped").alias("clamped"), F.first("config_pos").alias("config_pos"),
                *[F.first(c).alias(c) for c in ("house_budget", "own_budget", "risk_share")],
            )
            .withColumns({"kept": kept, "room": F.col("capacity") - kept})
        )
        households = write_through(households, "household-budgets")
        houses = households.groupBy(*key).agg(
            F.max("house_budget").alias("house_budget"), F.sum("kept").alias("kept_in_house"), F.sum("clamped").alias("clamped")
        )
        left = F.greatest(F.col("house_budget") - F.col("kept_in_house"), F.lit(0.0))
        has_room = F.col("room") > F.lit(self.params.cap_tolerance)
        levels = water_levels(
            households.where(has_room), key, room=F.col("room"), weight=F.col("risk_share"),
            amounts=houses.withColumn("amount", left),
        ).withColumnRenamed("level", "spill_level")
        spill = F.when(
            has_room, F.least(F.col("room"), F.coalesce("spill_level", F.lit(0.0)) * F.col("risk_share"))
        ).otherwise(F.lit(0.0))
        granted = households.join(levels, key, "left").select(*family, (F.col("kept") + spill).alias("amount"))
        granted = write_through(granted, "granted")
        filled = water_levels(
            risks, family, room=F.col("cap"), weight=F.col("weight"), amounts=granted,
            unfold=self._capped_rows, packed=[k for k in family if k not in self._tick and k != "household_id"],
        )
        placed = filled.join(households.select(*family, "config_pos"), family)
        entries = F.map_from_entries(F.collect_list(F.struct("config_pos", "level")))  # one per capped configuration
        return (
            placed.groupBy(*self._tick, "household_id").agg(entries.alias("levels")),
            houses.select(*key, "kept_in_house", F.col("clamped").alias("clamped_in_house")),
        )

    def unfold(self, rows: DataFrame) -> DataFrame:
        """Rows with the figures of ``self.rows``, repeated for the grid, with ``threshold`` and ``cap``."""
        rows = with_configs(rows, self.configs).withColumn("house_budget", F.col("epsilon") * F.col("mean_load"))
        modes = list(dict.fromkeys(c.mode for c in self.configs))
        cap = threshold = F.lit(None).cast("double")
        if CAPPED in modes:
            cap = F.when(F.col("mode") == CAPPED, self._cap()).otherwise(cap)
        rows = rows.withColumn("cap", cap)
        for mode in modes:
            if mode == CAPPED:
                level = F.coalesce(F.try_element_at(F.col("levels"), F.col("config_pos")), F.lit(0.0))
                own = F.least(F.col("cap"), level * plug_share())
            else:
                own = THRESHOLDS[mode]()
            threshold = F.when(F.col("mode") == mode, own).otherwise(threshold)
        return rows.withColumn("threshold", threshold)

    def _household_sums(self) -> DataFrame:
        """Totals of every configuration, tick and household: used and unused budget, household budget, cap figures."""
        key, family = ["config_id", *TICK], ["config_id", *TICK, "household_id"]
        hit = F.col("cap") - F.col("threshold") <= F.lit(self.params.cap_tolerance)
        rows = self.unfold(self.rows.withColumn("_unit", unit_of(F.col("mean_load")))).withColumn("household_share", household_share())
        whole = coarse(F.col("threshold"), F.col("_unit"))
        shares = rows.groupBy("config_pos", "mode", *family).agg(
            F.sum(whole).alias("_coarse"), F.sum(F.col("threshold") - whole).alias("_fine"), F.count_if(hit).cast("bigint").alias("_hits"),
            F.count("*").alias("trace_rows"),
            *[F.first(c).alias(c) for c in ("tick_us", "house_budget", "household_share")],
        )
        shares = write_through(shares.withColumn("spent_in_household", F.col("_coarse") + F.col("_fine")), "spent")
        totals = shares.groupBy(*key).agg(
            (F.sum("_coarse") + F.sum("_fine")).alias("used_budget"), F.sum("_hits").alias("cap_hit_count")
        )
        capped = F.col("mode") == CAPPED
        within = spill = F.lit(0.0)
        if self._kept is not None:
            totals = totals.join(self._kept, key, "left")
            moved = F.greatest(F.col("kept_in_house") - F.col("clamped_in_house"), F.lit(0.0))
            within = F.when(capped, moved).otherwise(within)
            beyond = F.greatest(F.col("used_budget") - F.col("kept_in_house"), F.lit(0.0))
            spill = F.when(capped, beyond).otherwise(spill)
        shared = F.when(
            F.col("mode") == "true_hierarchical", F.col("house_budget") * F.col("household_share")
        ).otherwise(F.col("spent_in_household"))
        booked = shares.join(totals, key).withColumns(
            {
                "unused_budget": F.greatest(F.col("house_budget") - F.col("used_budget"), F.lit(0.0)),
                "household_budget": shared,
                "within_household_redistributed_budget": within,
                "cross_household_spill_budget": spill,
                "allocation_timestamp": F.timestamp_micros("tick_us"),
            }
        )
        booked = booked.select(
            "config_pos", *family, "mode", "allocation_timestamp", "house_budget", "trace_rows", *BOOKED
        )
        return write_through(booked, "booked")

    def budgets(self) -> DataFrame:
        """`cycle_budgets` of the trace, without the trace."""
        return cycle_budgets(self.households, F.sum("trace_rows"))

    def trace(self) -> DataFrame:
        """One row per configuration, active plug and tick, with the totals of its household and house."""
        place = [*self._tick, "household_id"]
        entry = F.struct(*BOOKED)
        sums = self.households.groupBy(*place).agg(
            F.map_from_entries(F.collect_list(F.struct(F.col("config_pos"), entry))).alias("_sums")  # one per configuration
        )
        rows = self.unfold(self.rows.join(sums, place))
        mine = F.try_element_at(F.col("_sums"), F.col("config_pos"))
        rows = rows.select("*", mine.alias("_own")).select(
            "*", *[F.col(f"_own.{c}").alias(c) for c in BOOKED],
            F.timestamp_micros("tick_us").alias("allocation_timestamp"), F.timestamp_micros("tick_us").alias("effective_after"),
        )
        return rows.select(*TRACE_COLUMNS, "config_pos")

    def meet(self, events: DataFrame) -> DataFrame:
        """`decide.with_thresholds`, without the trace: events meet the packed row of their plug and cycle."""
        given = [c for c in events.columns if c != "mean_load"]
        figures = [c for c in self.rows.columns if c not in events.columns]
        mine = self.rows.select(*TICK, *PLUG[1:], *figures, F.lit(True).alias("_met"))
        rows = self.unfold(events.join(mine, [*TICK, *PLUG[1:]], "left"))
        return rows.select(
            *given, "config_pos",
            F.when(F.col("_met"), F.col("threshold")).otherwise(F.lit(0.0)).alias("threshold_used"),
            F.when(F.col("_met"), F.col("cap")).alias("cap"), "config_id", "mode", "house_budget",
        )


def cycle_budgets(trace: DataFrame, rows: Column | None = None) -> DataFrame:
    """One row per configuration, house and allocation that has active plugs."""
    return trace.groupBy("config_id", "mode", "house_id", "cycle").agg(
        F.max("allocation_timestamp").alias("allocation_timestamp"),
        F.max("house_budget").alias("house_budget"),
        F.max("used_budget").alias("used_budget"),
        F.max("unused_budget").alias("unused_budget"),
        F.max("cap_hit_count").alias("cap_hit_count"),
        F.max("within_household_redistributed_budget").alias(
            "within_household_redistributed_budget"
        ),
        F.max("cross_household_spill_budget").alias("cross_household_spill_budget"),
        (F.count("*") if rows is None else rows).alias("trace_rows"),
    )


def missing_caps(active: DataFrame, quantiles: DataFrame, min_samples: int = 1) -> DataFrame:
    """Active plugs whose cap cannot come from their own residuals: too few samples or none.

    The allocation gives them the share of the house budget instead.
    """
    enough = quantiles.where(F.col("samples") >= min_samples)
    return active.join(enough.select(*PLUG), PLUG, "left_anti").select(*TICK, *PLUG[1:])
