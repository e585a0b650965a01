"""Spark operators against the plain sequential model, event by event."""

import math

import pyarrow as pa
import pytest

from bandwise.operators import fold
from bandwise.params import AdaptiveConfig, AllocationConfig, mode_grid
from bandwise.plans.adaptive import AdaptiveRun
from bandwise.plans.coupled import ProxyRun
from bandwise.plans.frozen import Study
from tests import brute
from tests.fixtures import SCHEMA, as_dicts, drifting_house, house_params


@pytest.fixture(scope="module")
def rows():
    return [*drifting_house(house=0), *drifting_house(seed=11, house=5)]


@pytest.fixture(scope="module")
def study(spark, rows):
    return Study(spark.createDataFrame(rows, SCHEMA), house_params())


CAPS = dict(cap_fraction=0.3, cap_min_samples=5)


def close(a, b):
    if a is None or b is None:
        return a is b
    return math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)


def test_frozen_modes_match(study, rows):
    run = study.run(mode_grid(epsilons=(0.05,), **CAPS))
    got = {
        (r.config_id, r.house_id, r.original_row_index): r
        for r in run.full_decisions().collect()
    }
    trace = {
        (r.config_id, r.house_id, r.tick, r.household_id, r.plug_id): r
        for r in run.trace.selectExpr("*", "unix_micros(allocation_timestamp) as tick").collect()
    }
    checked = allocated = 0
    for config in run.configs:
        for house in (0, 5):
            out, ticks, _ = brute.replay(as_dicts(rows, house), study.params, config)
            for row, delta, sent, reason, streak, score, prediction, _bias in out:
                r = got[config.config_id, house, row]
                assert close(r.threshold_used, delta)
                assert (r.transmitted, r.forced_reason) == (sent, reason)
                assert r.consecutive_suppression == streak
                assert close(r.residual_score, score)
                assert close(r.prediction, prediction)
                checked += 1
            for now, (hh, plug), score, delta in ticks:
                r = trace[config.config_id, house, now, hh, plug]
                assert close(r.score, score) and close(r.threshold, delta)
                allocated += 1
    assert checked == len(got) and allocated == len(trace)


def test_proxy_matches(study, rows):
    configs = mode_grid(("flat_variance", "true_hierarchical_cap"), (0.05,), **CAPS)
    got = {
        (r.config_id, r.house_id, r.row_id): r for r in ProxyRun(study, configs).decisions.collect()
    }
    checked = 0
    for config in configs:
        for house in (0, 5):
            out, _, _ = brute.replay(
                as_dicts(rows, house), study.params, config, estimator="uniform_proxy"
            )
            for row, delta, sent, reason, *_ in out:
                r = got[config.config_id, house, row]
                assert close(r.threshold_used, delta)
                assert (r.transmitted, r.forced_reason) == (sent, reason)
                checked += 1
    assert checked == len(got)


def candidates(mode):
    common = dict(alpha=0.3, detector="cusum", kappa=0.4, threshold_h=3.0, cooldown=2,
                  max_suppressions=5, max_silence=9000)
    names = (
        "slot_median_frozen",
        "slot_median_ewma",
        "slot_median_ewma_periodic_sync",
        "slot_median_ewma_drift",
        "slot_median_ewma_drift_periodic_sync",
        "slot_median_ewma_local_oracle",
    )
    made = [
        AdaptiveConfig(AllocationConfig(f"{mode}/{n}", mode, 0.05, **CAPS), n, **common)
        for n in names
    ]
    made.append(
        AdaptiveConfig(
            AllocationConfig(f"{mode}/z", mode, 0.05, **CAPS),
            "slot_median_ewma_drift",
            alpha=0.2, bias_from_warmup=True, detector="zscore_consecutive",
            z_threshold=1.5, z_count=2, cooldown=1,
        )
    )
    return made


@pytest.mark.parametrize("mode,estimator", [
    ("uniform", "exact"), ("full_tx", "exact"),
    ("flat_variance", "exact"), ("true_hierarchical_cap", "uniform_proxy"),
])
def test_adaptive_modes_match(study, rows, mode, estimator):
    configs = candidates(mode)
    run = AdaptiveRun(study, configs, estimator=estimator)
    got = {(r.config_id, r.house_id, r.row_id): r for r in run.decisions.collect()}
    checked, reasons = 0, set()
    for config in configs:
        for house in (0, 5):
            out, _, _ = brute.replay(
                as_dicts(rows, house), study.params, config.allocation,
                estimator=estimator, predictor=config,
            )
            for row, delta, sent, reason, streak, _score, prediction, _bias in out:
                r = got[config.config_id, house, row]
                assert close(r.threshold_used, delta)
                assert (r.transmitted, r.forced_reason) == (sent, reason)
                assert r.consecutive_suppression == streak
                assert close(r.prediction, prediction)
                reasons.add(reason)
                checked += 1
    assert checked == len(got)
    if mode == "uniform":
        assert {"drift_detected", "periodic_sync_count", "normal_deadband"} <= reasons


def test_folding_in_slices_changes_nothing(study, spark, rows):
    configs = candidates("uniform")
    whole = AdaptiveRun(study, configs)
    sliced = AdaptiveRun(study.derive(slice_rows=20), configs)
    left, right = whole.decisions, sliced.decisions
    assert left.exceptAll(right).count() == 0 and right.exceptAll(left).count() == 0


def test_predictors_of_one_allocation_share_its_trace(study, monkeypatch):
    """Score-free thresholds are worked out once, and a plug's rows are counted without the grid."""
    allocated, counted = [], []
    run, count = Study.run, fold.bounded_slices
    monkeypatch.setattr(Study, "run", lambda own, configs: allocated.append(len(configs)) or run(own, configs))
    monkeypatch.setattr(fold, "bounded_slices", lambda rows, *rest: counted.append(rows.columns) or count(rows, *rest))
    loose = AllocationConfig("loose", "uniform", 0.2, **CAPS)
    configs = [*candidates("uniform"), AdaptiveConfig(loose, predictor_mode="slot_median_ewma")]
    together = AdaptiveRun(study, configs)
    trace = together.trace
    assert allocated == [2] and "config_id" not in counted[0]
    figures = ["config_pos", "cycle", "plug_id", "threshold"]
    found = {tuple(r) for r in trace.where("house_id = 0").select("config_id", "household_id", *figures).collect()}
    for place in (1, len(configs) - 1):
        alone = run(study, [configs[place].allocation]).trace.where("house_id = 0")
        rows = alone.select("config_id", "household_id", "cycle", "plug_id", "threshold").collect()
        want = {(r.config_id, r.household_id, place, r.cycle, r.plug_id, r.threshold) for r in rows}
        assert want and want == {f for f in found if f[2] == place}


def test_listed_columns_and_runs_of_keys():
    columns = {
        "a": pa.array([1, 1, None, None, 2]), "b": pa.array(["x", "x", "x", "x", "x"]),
        "v": pa.array([1.5, None, math.inf, 0.0, None]), "f": pa.array([True, None, False, True, True]),
    }
    batch = pa.RecordBatch.from_pydict(columns)
    assert all(fold.listed(batch.column(n)) == batch.column(n).to_pylist() for n in columns)
    borders = fold.runs_of_keys(batch, ["a", "b"])
    assert borders == [0, 2, 4, 5] and fold.runs_of_keys(batch.slice(0, 0), ["a"]) == []
    assert list(fold.keys_at(batch, ["a", "b"], borders[:-1])) == [(1, "x"), (None, "x"), (2, "x")]
