"""The whole analysis with the frozen predictor, for all houses and a grid of configurations."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import replace
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bandwise.operators import allocate as alloc
from bandwise.operators import cycles, decide, fit, metrics, score, splits
from bandwise.params import AllocationConfig, Params
from bandwise.session import configure, write_through
from bandwise.sources.events import PLUG


class Study:
    """Tables of one study, built when first asked for; shared ones are written once.

    ``events`` are accepted events.  ``predictor`` replaces the seasonal medians: it adds
    ``prediction`` and ``residual`` to events.
    """

    def __init__(
        self,
        events: DataFrame,
        params: Params,
        *,
        predictor: Callable[[DataFrame], DataFrame] | None = None,
    ):
        configure(events.sparkSession)
        self._predictor = predictor
        self.params = params
        self.events = events
        self.warm = events.where(splits.inside(params.warmup))
        self.evaluation = events.where(splits.inside(params.evaluation))
        self._quantiles: dict[tuple[float, ...], DataFrame] = {}

    def hold(self, table: DataFrame, name: str) -> DataFrame:
        """Write a table that several plans share to the shared folder and read it from there.

        Later plans see a short scan with a known size, so joins with it are broadcast only while
        it is small, and a lost executor costs no more than the stage it was working on.
        """
        return write_through(table, name)

    def derive(self, **changes) -> Study:
        """The same events under changed parameters."""
        params = replace(self.params, **changes)
        return Study(self.events, params, predictor=self._predictor)

    # warm-up -------------------------------------------------------------------------------

    @cached_property
    def slot_medians(self) -> DataFrame:
        fitted = fit.slot_medians(self.warm, self.params.slot_seconds)
        return self.hold(fitted, "slot_medians")

    @cached_property
    def plug_medians(self) -> DataFrame:
        return self.hold(fit.plug_medians(self.warm), "plug_medians")

    def predict(self, events: DataFrame) -> DataFrame:
        if self._predictor is not None:
            return self._predictor(events)
        return fit.predict(
            events, self.slot_medians, self.plug_medians, self.params.slot_seconds
        )

    @cached_property
    def warm_residuals(self) -> DataFrame:
        return self.predict(self.warm)

    @cached_property
    def sigma_floors(self) -> DataFrame:
        return self.houses.select("house_id", "sigma_floor")

    @cached_property
    def houses(self) -> DataFrame:
        """``mean_load`` and ``sigma_floor`` per house.

        Every plan joins its events with them, so a house without warm-up is an error here.
        """
        if not self.params.validation:  # a study with validation runs on its parts
            splits.check_splits(self.events, self.params)
        floors = fit.sigma_floors(
            fit.plug_sigmas(self.warm_residuals), self.params.floor_percentile
        )
        return self.hold(fit.mean_loads(self.warm).join(floors, "house_id"), "houses")

    def quantiles(self, configs: Sequence[AllocationConfig]) -> DataFrame:
        probs = tuple(sorted({*fit.BASE_QUANTILES, *(c.cap_quantile for c in configs)}))
        if probs not in self._quantiles:
            self._quantiles[probs] = self.hold(
                fit.residual_quantiles(self.warm_residuals, probs), "quantiles"
            )
        return self._quantiles[probs]

    @cached_property
    def tail(self) -> DataFrame:
        """Squares of the last residuals of the warm-up, as events of cycle -1."""
        fitted = fit.warmup_tail(self.warm_residuals, self.params.window, self.params)
        return self.hold(fitted, "tail")

    # evaluation ----------------------------------------------------------------------------

    @cached_property
    def ticks(self) -> DataFrame:
        return self.hold(cycles.allocation_ticks(self.evaluation, self.params), "ticks")

    @cached_property
    def scored(self) -> DataFrame:
        """Evaluation events with cycle, prediction, residual and its square."""
        rows = cycles.assign_cycle(self.predict(self.evaluation), self.ticks, self.params)
        rows = rows.withColumn("sq", F.col("residual") * F.col("residual"))
        return cycles.by_slice(self.hold(rows, "scored"))

    @cached_property
    def warm_plugs(self) -> DataFrame:
        last = fit.last_seen(self.warm).select(*PLUG, F.unix_micros("last_seen").alias("last_us"))
        tails = self.tail.groupBy(*PLUG).agg(F.count("*").alias("n"))
        return last.join(tails, PLUG, "left")

    @cached_property
    def states(self) -> DataFrame:
        states = cycles.slice_states(self.scored, self.warm_plugs)
        return self.hold(states.join(self.houses, "house_id"), "states")

    @cached_property
    def active(self) -> DataFrame:
        return cycles.active_sets(self.states, self.ticks, self.params)

    @cached_property
    def residual_rows(self) -> DataFrame:
        """Squares in order: the warm-up tail (cycle -1), then the evaluation."""
        before = self.tail.select(
            "house_id",
            F.lit(-1).cast("bigint").alias("cycle"),
            "household_id",
            "plug_id",
            "ts_us",
            "row_id",
            "sq",
        )
        current = self.scored.select(*cycles.SLICE, "ts_us", "row_id", "sq")
        return current.unionByName(before)

    @cached_property
    def snapshots(self) -> DataFrame:
        """Active plugs with their score at every tick."""
        scores = score.scores_at_ticks(
            self.active, self.states, self.residual_rows, self.params
        )
        return self.hold(scores, "snapshots")

    @cached_property
    def seen(self) -> DataFrame:
        """Scored events with last-seen time and reactivation flag."""
        return cycles.with_last_seen(self.scored, self.states, self.params)

    def seen_with_scores(self) -> DataFrame:
        """Like ``seen`` with the score every event meets (one more pass over the residuals)."""
        return score.scores_at_events(
            self.seen, self.states, self.residual_rows, self.params
        )

    # configurations ------------------------------------------------------------------------

    def run(self, configs: Sequence[AllocationConfig]) -> FrozenRun:
        return FrozenRun(self, list(configs))


class FrozenRun:
    """Trace, decisions, batches and reports of a grid of configurations."""

    def __init__(self, study: Study, configs: list[AllocationConfig]):
        if len({c.config_id for c in configs}) != len(configs) or not configs:
            raise ValueError("configurations must be non-empty and unique")
        self.study = study
        self.configs = configs

    @cached_property
    def allocation(self) -> alloc.Allocation:
        capped = any(c.mode == "true_hierarchical_cap" for c in self.configs)
        quantiles = self.study.quantiles(self.configs) if capped else None
        study = self.study
        return alloc.Allocation(study.snapshots, None, quantiles, self.configs, study.params)

    @cached_property
    def trace(self) -> DataFrame:
        return self.study.hold(self.allocation.trace(), "trace")

    @cached_property
    def budgets(self) -> DataFrame:
        return self.allocation.budgets()

    def _thresholded(self, events: DataFrame) -> DataFrame:
        return self.allocation.meet(events)

    def _decide(self, events: DataFrame) -> DataFrame:
        return decide.decide(self._thresholded(events))

    @cached_property
    def decisions(self) -> DataFrame:
        return self._decide(self.study.seen)

    def full_decisions(self) -> DataFrame:
        """All reported decision columns, with score, streak and batch error."""
        rows = self._decide(self.study.seen_with_scores())
        return decide.decision_table(decide.with_batch_error(decide.with_streaks(rows)))

    @cached_property
    def streaks(self) -> DataFrame:
        return decide.with_streaks(self.decisions)

    @cached_property
    def batches(self) -> DataFrame:
        """One row per configuration, house and timestamp; every report starts from it."""
        rolled = decide.roll_up(
            self.decisions, self.budgets, self.study.params, reasons=decide.FORCED_REASONS
        )
        return self.study.hold(rolled, "batches")

    def summary(self, *, streaks: bool = True) -> DataFrame:
        return metrics.summarize(
            self.batches,
            self.budgets,
            decide.longest_streaks(self.decisions) if streaks else None,
        )

    def daily(self) -> DataFrame:
        return metrics.daily_metrics(self.batches)

    def households(self) -> DataFrame:
        return metrics.household_metrics(self.decisions, self.trace)

    def plugs(self) -> DataFrame:
        return metrics.plug_metrics(self.decisions)

    def outliers(self, k: int | None = None) -> DataFrame:
        return metrics.top_outliers(
            self.decisions,
            self.batches,
            k or self.study.params.top_k,
            self.study.params.tie_digits,
        )
