"""The comparisons users ask for, each as a handful of grid jobs."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace
from datetime import timedelta
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bandwise.operators import adaptive as ad
from bandwise.operators import compare, metrics, splits
from bandwise.params import (
    MODES,
    PREDICTOR_MODES,
    AdaptiveConfig,
    AllocationConfig,
    mode_grid,
)
from bandwise.plans.adaptive import AdaptiveRun
from bandwise.plans.coupled import ProxyRun
from bandwise.plans.frozen import FrozenRun, Study

# Sweep grids and staged search grids.
EPSILONS = (0.0025, 0.005, 0.01, 0.015, 0.02, 0.03, 0.05, 0.075, 0.10)
PARETO_MODES = ("uniform", "flat_variance", "true_hierarchical", "true_hierarchical_cap")
PREDICTOR_EPSILONS = (0.005, 0.01, 0.02, 0.03, 0.05, 0.075, 0.10)
OFAT_GRID = {
    "alpha_fair": (0.10, 0.20, 0.40),
    "beta": (0.00, 0.10, 0.20),
    "cap_quantile": (0.90, 0.95, 0.99),
    "cap_multiplier": (0.5, 1.0, 1.5),
    "cap_fraction": (0.10, 0.25, 0.50),
}
OFAT_NAMES = {
    "alpha_fair": "alpha",
    "beta": "beta",
    "cap_quantile": "cap.quantile",
    "cap_multiplier": "cap.multiplier",
    "cap_fraction": "cap.max_house_budget_fraction",
}
ALPHAS = (0.01, 0.05, 0.10, 0.20, 0.40)
KAPPAS = (0.25, 0.50, 1.00)
CUSUM_LIMITS = (3.0, 5.0, 8.0)
SUPPRESSION_LIMITS = (20, 50, 100, 200, None)
SILENCE_LIMITS = (300, 900, 1800, 3600, None)
PICK_ORDER = ("cvar99", "rmse", "max", "transmission_ratio")
PICK_DIGITS = 9  # of the search's figures, unless the study gives its own


def _labels(configs: Sequence, field: str) -> Column:
    """A per-configuration value of a bounded grid, looked up by ``config_id``."""
    pairs = [F.lit(x) for c in configs for x in (c.config_id, getattr(c, field))]
    return F.create_map(*pairs)[F.col("config_id")]


# allocators ------------------------------------------------------------------------------------


def compare_modes(
    study: Study, epsilon: float, modes: Sequence[str] = MODES, **common: float
) -> FrozenRun:
    """All allocator modes in one run; its ``summary()`` has one row per mode and house."""
    return study.run(mode_grid(modes, (epsilon,), **common))


def sweep_points(run: FrozenRun) -> DataFrame:
    """Trade-off points of a grid, without the pass for streaks."""
    return run.summary(streaks=False).select(
        "house_id",
        "mode",
        _labels(run.configs, "epsilon").alias("epsilon"),
        "transmission_ratio",
        "rmse",
        "cvar99",
        "mae",
        "p99",
        "max",
        "safety_pass",
    )


def pareto_sweep(
    study: Study,
    epsilons: Sequence[float] = EPSILONS,
    modes: Sequence[str] = PARETO_MODES,
    **common: float,
) -> DataFrame:
    return sweep_points(study.run(mode_grid(modes, epsilons, **common)))


def one_at_a_time(base: AllocationConfig) -> list[AllocationConfig]:
    """The base configuration and every single change of a grid value."""
    variants = [replace(base, config_id="base")]
    for field, values in OFAT_GRID.items():
        for value in values:
            if value != getattr(base, field):
                name = f"{OFAT_NAMES[field]}={value}"
                variants.append(replace(base, config_id=name, **{field: value}))
    return variants


def sensitivity(study: Study, base: AllocationConfig) -> DataFrame:
    """One-factor-at-a-time candidates on the validation interval, the best pick marked."""
    tuned = Study(study.events, study.params.on_validation())
    summary = tuned.run(one_at_a_time(base)).summary(streaks=False)
    rows = summary.select(
        "house_id",
        F.col("config_id").alias("candidate"),
        "cvar99",
        "rmse",
        "transmission_ratio",
        "safety_pass",
    )
    picked = compare.best_pick(
        rows.where("safety_pass"),
        ["house_id"],
        ["cvar99", "rmse", "transmission_ratio", "candidate"],
        study.params.tie_digits,
    ).select("house_id", "candidate", F.lit(True).alias("selected"))
    return rows.join(picked, ["house_id", "candidate"], "left").fillna(False, ["selected"])


class HouseStudy:
    """Six modes, hierarchy effect, equivalence, caps, sweep, matches and the proxy, per house."""

    def __init__(self, study: Study, epsilon: float, epsilons: Sequence[float], **common: float):
        self.study, self.epsilon, self.epsilons, self.common = study, epsilon, epsilons, common

    @cached_property
    def run(self) -> FrozenRun:
        return compare_modes(self.study, self.epsilon, **self.common)

    def _of(self, table: DataFrame, mode: str) -> DataFrame:
        return table.where(F.col("mode") == mode)

    def comparison(self) -> DataFrame:
        return self.run.summary()

    def tails(self) -> DataFrame:
        return compare.tail_comparison(self.run.summary(streaks=False))

    def hierarchy_cycles(self) -> DataFrame:
        trace = self.run.trace
        return compare.hierarchy_cycles(
            self._of(trace, "flat_variance"),
            self._of(trace, "true_hierarchical"),
            self.study.params.tolerance,
        )

    def legacy_equivalence(self) -> DataFrame:
        trace, decisions = self.run.trace, self.run.decisions
        return compare.threshold_equivalence(
            self._of(trace, "flat_variance"),
            self._of(trace, "legacy_two_stage"),
            self._of(decisions, "flat_variance"),
            self._of(decisions, "legacy_two_stage"),
            self.study.params.tolerance,
        )

    def cap_diagnostics(self) -> DataFrame:
        caps = self._of(self.run.trace, "true_hierarchical_cap")
        return metrics.budget_metrics(caps).drop("budget_violation_count")

    @cached_property
    def points(self) -> DataFrame:
        return self.study.hold(
            pareto_sweep(self.study, self.epsilons, **self.common), "sweep-points"
        )

    def matched(self) -> DataFrame:
        return compare.matched_transmission(
            self.points, digits=self.study.params.tie_digits
        )

    @cached_property
    def proxy_runs(self) -> tuple[FrozenRun, ProxyRun]:
        configs = mode_grid(
            ("true_hierarchical", "true_hierarchical_cap"), (self.epsilon,), **self.common
        )
        return self.study.run(configs), ProxyRun(self.study, configs)

    def exact_proxy(self) -> DataFrame:
        exact, proxy = self.proxy_runs
        return compare.exact_proxy_comparison(
            exact.trace,
            proxy.trace,
            exact.decisions,
            proxy.decisions,
            exact.summary(streaks=False),
            proxy.summary(streaks=False),
        )

    def verdict(self) -> DataFrame:
        """What the study suggests next, per house."""
        effect = compare.hierarchy_effect(self.hierarchy_cycles())
        summary = self.run.summary(streaks=False)

        def tail(mode: str) -> Column:
            return F.max(F.when(F.col("mode") == mode, F.col("cvar99")))

        compared = summary.groupBy("house_id").agg(
            (tail("true_hierarchical_cap") < tail("true_hierarchical")).alias("cap_improved"),
            (tail("true_hierarchical") < tail("flat_variance")).alias("hierarchy_improved"),
            (
                F.max(
                    F.when(F.col("mode") == "true_hierarchical_cap", F.col("cap_hit_rate"))
                )
                > 0
            ).alias("cap_active"),
        )
        acts = F.coalesce("hierarchy_effect_rate", F.lit(0.0)) >= 0.5
        return (
            compared.join(effect.select("house_id", "hierarchy_effect_rate"), "house_id", "left")
            .fillna(0.0, ["hierarchy_effect_rate"])
            .withColumn(
                "decision",
                F.when(
                    acts
                    & F.col("hierarchy_improved")
                    & F.col("cap_active")
                    & F.col("cap_improved"),
                    "verify_on_more_houses",
                )
                .when(acts & ~F.col("hierarchy_improved"), "try_empirical_cdf_allocator")
                .otherwise("improve_predictor_first"),
            )
        )


# predictors --------------------------------------------------------------------------------------


def predictor_grid(
    allocators: Sequence[AllocationConfig],
    template: AdaptiveConfig,
    predictor_modes: Sequence[str] = PREDICTOR_MODES,
) -> list[AdaptiveConfig]:
    return [
        replace(
            template,
            allocation=replace(a, config_id=f"{a.config_id}/{mode}"),
            predictor_mode=mode,
        )
        for a in allocators
        for mode in predictor_modes
    ]


def predictor_rows(run: AdaptiveRun) -> DataFrame:
    """Summary and predictor figures of every candidate and house, with the safety verdict."""
    base = run.summary().drop("safety_pass", "forced_transmit")
    figures = run.predictor_summary().drop("events")
    joined = base.join(figures, ["config_id", "house_id"])
    return joined.withColumn(
        "safety_pass", metrics.safety_pass("predictor_state_divergence_count")
    )


_COMPARED = [
    "predictor_mode",
    "deployable",
    "transmission_ratio",
    "rmse",
    "cvar99",
    "max",
    "prediction_rmse",
    "prediction_cvar99",
    "drift_trigger_count",
    "periodic_sync_count_trigger_count",
    "periodic_sync_time_trigger_count",
    "predictor_state_divergence_count",
]


def _triggers() -> Column:
    return (
        F.col("drift_trigger_count")
        + F.col("periodic_sync_count_trigger_count")
        + F.col("periodic_sync_time_trigger_count")
    )


class PredictorComparison:
    """The five deployable predictors for one allocator: deltas, rejection, selection, causes."""

    def __init__(
        self,
        study: Study,
        allocation: AllocationConfig,
        template: AdaptiveConfig,
        maximum_additional_tr: float = 0.03,
    ):
        if not template.enabled:
            raise ValueError("comparing predictors needs the adaptive predictor enabled")
        self.study, self.allocation, self.template = study, allocation, template
        self.limit = maximum_additional_tr

    @cached_property
    def run(self) -> AdaptiveRun:
        return AdaptiveRun(self.study, predictor_grid([self.allocation], self.template))

    @cached_property
    def rows(self) -> DataFrame:
        """One row per predictor and house."""
        deltas = compare.against_frozen(
            predictor_rows(self.run).select("config_id", "house_id", "mode", "safety_pass",
                                            *_COMPARED)
        )
        costly = F.col("additional_TR_vs_frozen") > F.lit(self.limit)
        rows = deltas.withColumns(
            {
                "rejected": costly | ~F.col("safety_pass"),
                "rejection_reason": F.when(costly, "additional_tr_limit").when(
                    ~F.col("safety_pass"), "safety"
                ),
            }
        ).withColumnRenamed("mode", "allocator_mode")
        return self.study.hold(rows, "predictors")

    def selected(self) -> DataFrame:
        """Best eligible adaptive predictor per house; a house without one has no row."""
        eligible = self.rows.where(
            ~F.col("rejected")
            & F.col("deployable")
            & (F.col("predictor_mode") != "slot_median_frozen")
        )
        listed = F.array_position(F.array(*map(F.lit, PREDICTOR_MODES)), F.col("predictor_mode"))
        return compare.best_pick(
            eligible,
            ["house_id"],
            [*PICK_ORDER, _triggers(), listed],
            self.study.params.tie_digits,
        )

    def causes(self, k: int | None = None) -> DataFrame:
        """Root causes of the outliers of the frozen and of each house's selected predictor."""
        outliers = self.run.outliers(k)
        frozen = outliers.where(F.col("predictor_mode") == "slot_median_frozen")
        chosen = self.selected().select("house_id", "config_id")
        rest = frozen.select("house_id", "config_id").distinct().join(
            chosen.select("house_id"), "house_id", "left_anti"
        )
        selected = outliers.join(chosen.unionByName(rest), ["house_id", "config_id"], "left_semi")
        return compare.root_causes(frozen, selected)

    def changes(self, k: int | None = None) -> DataFrame:
        """Overlap and precision figures against each house's selected predictor."""
        chosen = self.selected().select("house_id", "config_id")
        figures = self.run.predictor_summary().join(
            chosen, ["house_id", "config_id"], "left_semi"
        )
        return compare.outlier_changes(self.causes(k), figures)

    def matched_sweep(
        self, predictor_mode: str, epsilons: Sequence[float] = PREDICTOR_EPSILONS
    ) -> DataFrame:
        """Trade-off points of the frozen and one adaptive predictor over epsilons."""
        return predictor_points(
            self.study, self.allocation, self.template, predictor_mode, epsilons
        )


def predictor_points(
    study: Study,
    allocation: AllocationConfig,
    template: AdaptiveConfig,
    predictor_mode: str,
    epsilons: Sequence[float] = PREDICTOR_EPSILONS,
) -> DataFrame:
    allocators = [
        replace(allocation, config_id=f"{allocation.mode}@{e:g}", epsilon=e) for e in epsilons
    ]
    grid = predictor_grid(allocators, template, ("slot_median_frozen", predictor_mode))
    run = AdaptiveRun(study, grid)
    epsilon = F.create_map(*[F.lit(x) for c in grid for x in (c.config_id, c.allocation.epsilon)])
    points = run.summary().join(
        ad.prediction_metrics(run.decisions).select("config_id", "house_id", "prediction_rmse"),
        ["config_id", "house_id"],
    )
    label = F.create_map(*[F.lit(x) for c in grid for x in (c.config_id, c.effective_mode)])
    return study.hold(
        points.select(
            "house_id",
            F.col("mode").alias("allocator_mode"),
            label[F.col("config_id")].alias("predictor_mode"),
            epsilon[F.col("config_id")].alias("epsilon"),
            "transmission_ratio",
            "rmse",
            "cvar99",
            "max",
            "prediction_rmse",
            "safety_pass",
        ),
        "predictor-points",
    )


def predictor_matrix(
    study: Study,
    allocators: Sequence[AllocationConfig],
    template: AdaptiveConfig,
    predictor_modes: Sequence[str] = PREDICTOR_MODES,
    *,
    estimator: str = "exact",
) -> DataFrame:
    """Every allocator with every predictor."""
    if not template.enabled and any(m != "slot_median_frozen" for m in predictor_modes):
        raise ValueError("with the adaptive predictor disabled only the frozen mode can run")
    run = AdaptiveRun(
        study, predictor_grid(allocators, template, predictor_modes), estimator=estimator
    )
    return predictor_rows(run).select(
        "house_id",
        F.col("mode").alias("allocator_mode"),
        *[c for c in _COMPARED if c != "deployable"],
        "prediction_mae",
        "predictor_update_count",
        "safety_pass",
    )


class StagedSearch:
    """Four-stage search on the validation interval: alpha, CUSUM, count limit, silence limit.

    Every house is searched for itself: a stage is one job over a table of (house, candidate), in
    which a house has the candidates that follow from its own winner of the stage before.  What
    reaches the driver is the distinct winners, at most one per candidate of the grid.  A house whose
    candidates are all rejected stops at that stage and has no row in ``selected``.  If no house goes
    on, the search ends there: ``candidates`` has what was judged, and ``selected`` is an error.

    The data of every house must reach from the start of the warm-up to the end of the evaluation;
    ``slack`` allows for the distance between readings.
    """

    def __init__(
        self,
        study: Study,
        allocation: AllocationConfig,
        template: AdaptiveConfig,
        *,
        house_id: int | None = None,
        maximum_additional_tr: float = 0.03,
        maximum_unresolved_fraction: float = 0.5,
        slack: timedelta = timedelta(0),
    ):
        params = study.params.on_validation()
        events = study.events
        if house_id is not None:
            events = events.where(F.col("house_id") == house_id)
        splits.check_splits(events, study.params, slack)
        self.study = Study(events, params)
        self.allocation, self.template = allocation, template
        self.limit, self.unresolved_limit = maximum_additional_tr, maximum_unresolved_fraction

    def _candidate(self, name: str, mode: str, base: AdaptiveConfig, **changes) -> AdaptiveConfig:
        return replace(
            base,
            allocation=replace(self.allocation, config_id=name),
            predictor_mode=mode,
            **changes,
        )

    @cached_property
    def _frozen_ratio(self) -> DataFrame:
        frozen = self._candidate("frozen", "slot_median_frozen", self.template)
        summary = AdaptiveRun(self.study, [frozen]).summary()
        return self.study.hold(
            summary.select("house_id", F.col("transmission_ratio").alias("frozen_ratio")),
            "frozen-ratio",
        )

    def _stage(
        self, name: str, configs: Sequence[AdaptiveConfig], assigned: DataFrame
    ) -> DataFrame:
        """Judged candidates of a stage, one row per house and candidate."""
        run = AdaptiveRun(
            self.study, configs, assigned=assigned.select("house_id", "config_id")
        )
        drifts = F.col("drift_trigger_count")
        judged = (
            predictor_rows(run)
            .join(self._frozen_ratio, "house_id")
            .join(assigned, ["house_id", "config_id"])
            .withColumns(
                {
                    "additional_TR_vs_frozen": F.col("transmission_ratio") - F.col("frozen_ratio"),
                    "periodic_sync_trigger_count": F.col("periodic_sync_count_trigger_count")
                    + F.col("periodic_sync_time_trigger_count"),
                    "unresolved_drift_fraction": F.when(
                        drifts > 0, F.col("number_of_unresolved_drift_episodes") / drifts
                    ).otherwise(F.lit(0.0)),
                }
            )
        )
        reasons = F.array_compact(
            F.array(
                F.when(F.col("additional_TR_vs_frozen") > self.limit, "additional_tr_limit"),
                F.when(
                    F.col("unresolved_drift_fraction") > self.unresolved_limit,
                    "unresolved_drift_limit",
                ),
                F.when(~F.col("safety_pass"), "safety"),
            )
        )
        settings = {
            "alpha": "double",
            "detector": "string",
            "kappa": "double",
            "threshold_h": "double",
            "max_suppressions": "bigint",
            "max_silence": "bigint",
        }
        return self.study.hold(
            judged.withColumn("_reasons", reasons).select(
                "house_id",
                F.lit(name).alias("stage"),
                "candidate_id",
                "config_id",
                "predictor_mode",
                "transmission_ratio",
                "additional_TR_vs_frozen",
                "rmse",
                "cvar99",
                "max",
                "drift_trigger_count",
                "periodic_sync_trigger_count",
                "unresolved_drift_fraction",
                "safety_pass",
                *[_labels(configs, field).cast(kind).alias(field) for field, kind in settings.items()],
                (F.size("_reasons") > 0).alias("rejected"),
                F.nullif(F.array_join("_reasons", ","), F.lit("")).alias("rejection_reason"),
            ),
            f"stage-{name}",
        )

    def _winners(self, name: str, rows: DataFrame) -> DataFrame:
        """The best candidate of every house that has an eligible one."""
        order = [
            *PICK_ORDER,
            F.col("drift_trigger_count") + F.col("periodic_sync_trigger_count"),
            "candidate_id",
        ]
        # figures of equal candidates differ by the order in which Spark added them up
        digits = self.study.params.tie_digits
        best = compare.best_pick(
            rows.where(~F.col("rejected")), ["house_id"], order, PICK_DIGITS if digits is None else digits
        )
        return self.study.hold(best, f"winners-{name}")

    @cached_property
    def _search(self) -> tuple[DataFrame, DataFrame, list[AdaptiveConfig]]:
        both = "slot_median_ewma_drift_periodic_sync"
        off = dict(max_suppressions=None, max_silence=None)
        spark = self.study.events.sparkSession
        tables = []

        def label(limit):
            return "off" if limit is None else str(limit)

        # Names of the stages and of their candidates.
        stages = (
            (
                "A_alpha",
                lambda b: [
                    self._candidate(f"A-alpha-{a:.2f}", "slot_median_ewma", b, alpha=a,
                                    detector="none", **off)
                    for a in ALPHAS
                ],
            ),
            (
                "B_cusum",
                lambda b: [
                    self._candidate(f"B-cusum-k{k:.2f}-h{h:.1f}", "slot_median_ewma_drift", b,
                                    detector="cusum", kappa=k, threshold_h=h, **off)
                    for k in KAPPAS
                    for h in CUSUM_LIMITS
                ],
            ),
            (
                "C_count",
                lambda b: [
                    self._candidate(f"C-count-{label(n)}", both, b, max_suppressions=n,
                                    max_silence=None)
                    for n in SUPPRESSION_LIMITS
                ],
            ),
            (
                "C_time",
                lambda b: [
                    self._candidate(f"C-time-{label(n)}", both, b, max_silence=n)
                    for n in SILENCE_LIMITS
                ],
            ),
        )
        branches = [self.template]
        houses = self._frozen_ratio.select("house_id", F.lit(0).alias("branch"))
        for name, build in stages:
            # one candidate may follow from several winners, so its configurations are numbered by them
            grid = [
                (i, c.config_id, replace(c, allocation=replace(c.allocation, config_id=f"{c.config_id}|{i}")))
                for i, branch in enumerate(branches)
                for c in build(branch)
            ]
            configs = [c for _, _, c in grid]
            listed = spark.createDataFrame(
                [(i, c.config_id, label) for i, label, c in grid],
                "branch int, config_id string, candidate_id string",
            )
            assigned = self.study.hold(
                houses.join(listed, "branch").select("house_id", "config_id", "candidate_id"),
                f"assigned-{name}",
            )
            rows = self._stage(name, configs, assigned)
            tables.append(rows.drop("config_id"))
            winners = self._winners(name, rows)
            chosen = {r.config_id for r in winners.select("config_id").distinct().collect()}
            if not chosen:
                branches = []
                break
            branches = [c for c in configs if c.config_id in chosen]
            numbers = spark.createDataFrame(
                [(c.config_id, i) for i, c in enumerate(branches)], "config_id string, branch int"
            )
            houses = winners.join(numbers, "config_id").select("house_id", "branch")
        candidates = tables[0]
        for table in tables[1:]:
            candidates = candidates.unionByName(table)
        return candidates, winners, branches

    def _found(self) -> tuple[DataFrame, list[AdaptiveConfig]]:
        """Winners of the last stage and their configurations; an error if no house has one."""
        _, winners, branches = self._search
        if not branches:
            raise ValueError("all predictor validation candidates rejected in a stage of every house")
        return winners, branches

    @property
    def candidates(self) -> DataFrame:
        """All judged candidates: house, stage, settings, figures, and why one was rejected."""
        return self._search[0]

    @property
    def selected(self) -> DataFrame:
        """The winner of the last stage, with its settings, of every house that reached it."""
        return self._found()[0].drop("config_id")

    def on(self, study: Study) -> AdaptiveRun:
        """Every house with its own selected predictor, on another study, such as the evaluation's."""
        winners, branches = self._found()
        return AdaptiveRun(study, branches, assigned=winners.select("house_id", "config_id"))
