"""The whole analysis with adaptive predictors, for all houses and a grid of candidates."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bandwise.operators import adaptive, cycles, decide, fit, metrics
from bandwise.operators import allocate as alloc
from bandwise.operators.fold import fold_by_key
from bandwise.params import AdaptiveConfig, AllocationConfig
from bandwise.plans.coupled import Coupled
from bandwise.plans.frozen import Study
from bandwise.session import write_through
from bandwise.sources.events import PLUG

# Allocators that never read scores: their thresholds are known before any decision.
SCORE_FREE = ("full_tx", "uniform")


def _shared_allocations(
    configs: Sequence[AdaptiveConfig],
) -> tuple[list[AllocationConfig], dict[str, list[tuple[str, int]]]]:
    """The different allocations of score-free candidates, and who follows each: (config_id, place in the grid).

    Their thresholds do not depend on the predictor, so candidates that differ by it alone share one allocation.
    """
    first: dict[AllocationConfig, AllocationConfig] = {}
    followers: dict[str, list[tuple[str, int]]] = {}
    for place, config in enumerate(configs):
        allocation = config.allocation
        owner = first.setdefault(replace(allocation, config_id=""), allocation)
        followers.setdefault(owner.config_id, []).append((config.config_id, place))
    return list(first.values()), followers


def _repeated(part: DataFrame, followers: dict[str, list[tuple[str, int]]]) -> DataFrame:
    """The rows of an allocation once for each candidate that follows it."""
    if all(ids == [(owner, place)] for place, (owner, ids) in enumerate(followers.items())):
        return part
    names = F.create_map(
        *[
            x
            for owner, ids in followers.items()
            for x in (
                F.lit(owner),
                F.array(*[F.struct(F.lit(i).alias("config_id"), F.lit(n).alias("config_pos")) for i, n in ids]),
            )
        ]
    )
    columns = [c for c in part.columns if c not in ("config_id", "config_pos")]
    return part.select(*columns, F.inline(names[F.col("config_id")])).select(*part.columns)


class AdaptiveRun:
    """Decisions and reports of a grid of (allocator, predictor) candidates.

    ``assigned`` (house_id, config_id) lets every house run candidates of its own.  These share one
    allocator, whose thresholds are worked out once; a house's rows are repeated for its candidates only.
    """

    def __init__(
        self,
        study: Study,
        configs: Sequence[AdaptiveConfig],
        *,
        estimator: str = "exact",
        assigned: DataFrame | None = None,
    ):
        if len({c.config_id for c in configs}) != len(configs) or not configs:
            raise ValueError("configurations must be non-empty and unique")
        if assigned is not None:
            shared = {replace(c.allocation, config_id="") for c in configs}
            if len(shared) > 1 or configs[0].allocation.mode not in SCORE_FREE:
                raise ValueError("candidates per house need one allocator that reads no scores")
        self.assigned = assigned
        self.study = study
        self.configs = list(configs)
        self.estimator = estimator

    # warm-up -------------------------------------------------------------------------------

    @cached_property
    def scales(self) -> DataFrame:
        """Robust scale of every plug, with its fallbacks."""
        study = self.study
        least = study.params.drift_min_scale
        per_plug = study.hold(
            fit.drift_scales(
                fit.residual_mads(study.warm_residuals),
                study.sigma_floors,
                least,
            ),
            "scales",
        )
        return study.hold(
            fit.lookup_scales(
                study.events,
                per_plug,
                fit.household_scales(per_plug),
                fit.house_scales(per_plug, study.sigma_floors, least),
                least,
            ),
            "robust-scales",
        )

    @cached_property
    def biases(self) -> DataFrame | None:
        """Starting bias per plug and alpha, for the candidates that start from the warm-up."""
        alphas = sorted({c.alpha for c in self.configs if c.bias_from_warmup and c.adapts})
        if not alphas:
            return None
        study = self.study
        return study.hold(
            fit.warmup_biases(study.warm_residuals, alphas, study.params), "biases"
        )

    # decisions -----------------------------------------------------------------------------

    @cached_property
    def seen(self) -> DataFrame:
        """Events with last-seen time, robust scale and starting biases (one per alpha)."""
        study = self.study
        states = study.states.join(self.scales, PLUG)
        if self.biases is not None:
            by_alpha = self.biases.groupBy(*PLUG).agg(
                F.map_from_entries(F.collect_list(F.struct("alpha", "bias"))).alias("biases")
            )
            states = states.join(by_alpha, PLUG, "left")
        return cycles.with_last_seen(study.scored, states, study.params)

    def _rows(self, thresholded: DataFrame) -> DataFrame:
        """Input rows of the fold, from thresholded events."""
        rows = thresholded.withColumnRenamed("prediction", "baseline")
        if self.biases is None:
            rows = rows.withColumn("initial_bias", F.lit(0.0))
        else:
            of_config = F.create_map(
                *[
                    F.lit(x)
                    for c in self.configs
                    for x in (c.config_id, c.alpha if c.bias_from_warmup and c.adapts else -1.0)
                ]
            )
            found = F.try_element_at(F.col("biases"), of_config[F.col("config_id")])
            rows = rows.withColumn("initial_bias", F.coalesce(found, F.lit(0.0)))
        return rows.select(*[F.col(f.name).cast(f.dataType) for f in adaptive.INPUT.fields])

    @cached_property
    def _parts(self) -> tuple[DataFrame, DataFrame]:
        """Trace and decisions; free and coupled candidates go their own ways."""
        study = self.study
        traces, folds = [], []
        free = [c for c in self.configs if c.allocation.mode in SCORE_FREE]
        coupled = [c for c in self.configs if c.allocation.mode not in SCORE_FREE]
        if free:
            allocations, followers = _shared_allocations(free)
            trace = study.run(allocations).trace
            thresholded = decide.with_thresholds(self.seen, trace, allocations)
            if self.assigned is None:
                trace, thresholded = (_repeated(part, followers) for part in (trace, thresholded))
            else:
                thresholded, trace = (
                    part.drop("config_id").join(self.assigned, "house_id").select(*part.columns)
                    for part in (thresholded, trace)
                )
            rows = self._rows(thresholded)
            folded = fold_by_key(
                rows,
                adaptive.KEY,
                adaptive.ORDER,
                adaptive.adaptive_walk(free, study.params),
                adaptive.SCHEMA,
                adaptive.STATE,
                slice_col="cycle",
                max_rows=study.params.slice_rows,
                # a plug has the same events under every candidate
                sized=(study.scored, PLUG),
            )
            traces.append(trace)
            folds.append(write_through(folded, "decisions"))
        if coupled:
            walk = Coupled(
                study,
                [c.allocation for c in coupled],
                self.estimator,
                predictors=coupled,
                seen=self.seen,
            )
            trace, folded = walk.walk(self._rows)
            traces.append(trace)
            folds.append(folded)
        trace, folded = traces[0], folds[0]
        if len(traces) == 2:
            trace, folded = trace.unionByName(traces[1]), folded.unionByName(folds[1])
        return trace, folded

    @property
    def trace(self) -> DataFrame:
        return self._parts[0]

    @cached_property
    def decisions(self) -> DataFrame:
        return adaptive.finish(self._parts[1], self.configs)

    @cached_property
    def batches(self) -> DataFrame:
        rolled = decide.roll_up(
            self.decisions,
            alloc.cycle_budgets(self.trace),
            self.study.params,
            reasons=adaptive.ADAPTIVE_REASONS,
        )
        return self.study.hold(rolled, "batches")

    # reports -------------------------------------------------------------------------------

    def summary(self) -> DataFrame:
        return metrics.summarize(
            self.batches,
            alloc.cycle_budgets(self.trace),
            self.decisions.groupBy(*metrics.RUN).agg(
                F.max("consecutive_suppression").alias("maximum_consecutive_suppression")
            ),
            reasons=adaptive.ADAPTIVE_REASONS,
        )

    def predictor_summary(self) -> DataFrame:
        return adaptive.predictor_summary(
            self.decisions, self.configs, self.study.params
        )

    def plug_predictions(self) -> DataFrame:
        return adaptive.plug_predictions(self.decisions)

    def recovery(self) -> DataFrame:
        return adaptive.recovery_episodes(self.decisions)

    def outliers(self, k: int | None = None) -> DataFrame:
        return adaptive.prediction_outliers(self.decisions, k or self.study.params.top_k)
