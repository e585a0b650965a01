"""Allocators, water-filling, order statistics and comparisons on generated and fixed rows."""

import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from bandwise.functions import stats
from bandwise.operators import allocate as alloc
from bandwise.operators import compare, cycles, decide, drift, metrics, score
from bandwise.operators.adaptive import moved
from bandwise.operators.fit import quantile_name
from bandwise.operators import waterfill as water
from bandwise.operators.waterfill import waterfill
from bandwise.params import MODES, AllocationConfig, mode_grid
from tests import brute
from tests.fixtures import house_params

SNAP = "house_id bigint, cycle bigint, tick_us bigint, household_id bigint, plug_id bigint, " \
    "score double"
QUANT = "house_id bigint, household_id bigint, plug_id bigint, samples bigint, " + ", ".join(
    f"{quantile_name(p)} double" for p in (0.9, 0.95, 0.99)
)


def ticks(seed):
    """Many houses, each one tick with its own scores, budget and cap quantiles."""
    rng = random.Random(seed)
    snaps, quants, houses = [], [], []
    for house in range(60):
        n = rng.choice((1, 2, 3, 7, 20))
        houses.append((house, rng.choice((0.0, 1e-3, 10.0, 1e6)), rng.uniform(0.01, 3)))
        for i in range(n):
            score = rng.choice((0.01, 1.0, rng.uniform(0.01, 100), 1e6))
            snaps.append((house, 0, 0, i % 3, i, score))
            quants.append((house, i % 3, i, rng.choice((3, 99)), *[rng.uniform(0, 5)] * 3))
    return snaps, quants, houses


def test_allocators_on_generated_ticks(spark):
    snaps, quants, houses = ticks(5)
    params = house_params()
    configs = mode_grid(MODES, (1.0,), cap_fraction=0.2, cap_min_samples=30)
    trace = alloc.allocate(
        spark.createDataFrame(snaps, SNAP),
        spark.createDataFrame(houses, "house_id bigint, mean_load double, sigma_floor double"),
        spark.createDataFrame(quants, QUANT),
        configs,
        params,
    )
    got = {}
    for r in trace.collect():
        got.setdefault((r.mode, r.house_id), {})[r.household_id, r.plug_id] = r
    for house, budget, floor in houses:
        scores = {(h, p): s for hh, _, _, h, p, s in snaps if hh == house}
        fitted = {
            "floor": floor,
            "residuals": {
                (h, p): [q] * n for hh, h, p, n, q, *_ in quants if hh == house
            },
        }
        for config in configs:
            rows = got[config.mode, house]
            want = brute.divide(config, params, fitted, scores, budget)
            used = sum(r.threshold for r in rows.values())
            for key, delta in want.items():
                assert rows[key].threshold == pytest.approx(delta, rel=1e-7, abs=1e-7)
                assert rows[key].threshold >= 0
                if rows[key].cap is not None:
                    assert rows[key].threshold <= rows[key].cap + 1e-9
            assert used <= budget * (1 + 1e-12) + 1e-9
            one = next(iter(rows.values()))
            assert one.used_budget + one.unused_budget == pytest.approx(budget, abs=1e-6)


def test_flat_equals_legacy_and_caps_bind(spark):
    snaps = [(0, 0, 0, 0, 0, 1.0), (0, 0, 0, 0, 1, 3.0), (0, 0, 0, 1, 0, 6.0)]
    quants = [(0, 0, 0, 99, *[1.0] * 3), (0, 0, 1, 99, *[2.0] * 3), (0, 1, 0, 99, *[3.0] * 3)]
    trace = alloc.allocate(
        spark.createDataFrame(snaps, SNAP),
        spark.createDataFrame([(0, 10.0, 0.5)], "house_id long, mean_load double, sigma_floor double"),
        spark.createDataFrame(quants, QUANT),
        mode_grid(MODES, (1.0,), cap_fraction=1.0),
        house_params(),
    ).cache()

    def of(mode):
        rows = trace.where(F.col("mode") == mode).orderBy("household_id", "plug_id").collect()
        return [r.threshold for r in rows]

    assert of("uniform") == pytest.approx([10 / 3] * 3)
    assert of("flat_variance") == pytest.approx([1.0, 3.0, 6.0])
    assert of("legacy_two_stage") == pytest.approx(of("flat_variance"))
    assert of("full_tx") == [0.0] * 3
    assert of("true_hierarchical_cap") == pytest.approx([1.0, 2.0, 3.0])
    row = trace.where("mode = 'true_hierarchical_cap'").first()
    assert (row.used_budget, row.unused_budget, row.cap_hit_count) == (6.0, 4.0, 3)
    known = spark.createDataFrame(quants, QUANT).where("plug_id <> 1")
    lacking = alloc.missing_caps(trace.where("mode = 'uniform'"), known).collect()
    assert lacking and {r.plug_id for r in lacking} == {1}


def test_grid_stays_packed(spark, monkeypatch):
    """Nothing that an allocation of a grid writes has a row for each plug and configuration."""
    rng = random.Random(4)
    snaps = [(0, 0, 0, p % 2, p, rng.uniform(0.5, 9)) for p in range(40)]
    quants = [(0, p % 2, p, 99, *[rng.uniform(0, 5)] * 3) for p in range(40)]
    houses = spark.createDataFrame([(0, 10.0, 0.5)], "house_id long, mean_load double, sigma_floor double")
    written, write = {}, alloc.write_through

    def counted(table, name, **more):
        kept = write(table, name, **more)
        written[name] = kept.count()
        return kept

    monkeypatch.setattr(alloc, "write_through", counted)
    configs = mode_grid(MODES, (0.1, 0.5, 1.0, 2.0), cap_fraction=0.2)
    grid = alloc.Allocation(spark.createDataFrame(snaps, SNAP), houses, spark.createDataFrame(quants, QUANT), configs, house_params())
    assert written["levelled"] == 40 and max(written.values()) <= max(40, 2 * len(configs))
    trace = grid.trace()
    assert trace.count() == 40 * len(configs)
    # decisions meet the packed rows as they meet the trace; the last event's plug has no allocation
    events = spark.createDataFrame(
        [(0, 0, p % 2, p, 10.0, 0.5) for p in range(41)],
        "house_id long, cycle long, household_id long, plug_id long, mean_load double, sigma_floor double",
    )
    fields = ["config_id", "config_pos", "mode", "house_budget", "plug_id", "threshold_used", "cap"]
    got, want = (
        sorted(tuple(r) for r in rows.fillna(-1.0, ["cap"]).select(*fields).collect())
        for rows in (grid.meet(events), decide.with_thresholds(events, trace, configs))
    )
    assert len(got) == 41 * len(configs) and got == want
    budgets = ["config_id", "house_id", "cycle", "house_budget", "used_budget", "cap_hit_count", "trace_rows"]
    both = (sorted(tuple(r) for r in b.select(*budgets).collect()) for b in (grid.budgets(), alloc.cycle_budgets(trace)))
    assert next(both) == next(both)


def test_budget_is_kept_to_its_last_digits(spark):
    """Many equal or unlike shares of a large budget add up to it, so no violation is made up."""
    rng = random.Random(8)
    snaps = spark.createDataFrame([(0, 0, 0, p % 4, p, rng.uniform(0.5, 9)) for p in range(30_000)], SNAP).coalesce(1)
    houses = spark.createDataFrame([(0, 70_001.3, 0.5)], "house_id long, mean_load double, sigma_floor double")
    configs = mode_grid(("uniform", "flat_variance", "true_hierarchical"), (3.0, 7.5, 15.0))
    budgets = alloc.Allocation(snaps, houses, None, configs, house_params()).budgets()
    rows = metrics.budgets_over_cycles(budgets).collect()
    assert len(rows) == 9 and all(r.budget_violation_count == 0 for r in rows)


def test_own_allocator_and_predictor(spark):
    from bandwise.plans.frozen import Study
    from tests.fixtures import SCHEMA, drifting_house

    alloc.register_allocator("half_uniform", lambda: F.col("house_budget") / F.col("n_house") / 2)
    with pytest.raises(ValueError, match="exists"):
        alloc.register_allocator("half_uniform", lambda: F.lit(0.0))

    def constant(events):
        return events.withColumn("prediction", F.lit(50.0)).withColumn(
            "residual", F.col("value") - 50.0
        )

    events = spark.createDataFrame(drifting_house(), SCHEMA)
    study = Study(events, house_params(), predictor=constant)
    run = study.run(mode_grid(("half_uniform", "uniform"), (0.05,)))
    used = {r.mode: r.used_budget / r.house_budget for r in run.trace.collect()}
    assert used["half_uniform"] == pytest.approx(0.5) and used["uniform"] == pytest.approx(1.0)
    assert {r.prediction for r in run.decisions.collect()} == {50.0}


def test_unknown_mode_is_refused():
    with pytest.raises(ValueError, match="unknown mode"):
        AllocationConfig("x", "nothing")


def test_waterfill_equals_the_loop_even_for_zero_weights(spark):
    rng = random.Random(3)
    rows = []
    for group in range(80):
        n = rng.randint(1, 12)
        for i in range(n):
            cap = rng.choice((0.0, rng.uniform(0, 5)))
            weight = rng.choice((0.0, -1.0, 1.0, rng.uniform(0, 3)))
            rows.append((group, i, weight, rng.uniform(0, 1) * cap, cap, float(group % 9) * 2))
    df = spark.createDataFrame(
        rows, "g long, i long, weight double, current double, cap double, amount double"
    )
    got = {
        (r.g, r.i): r.filled
        for r in waterfill(
            df, ["g"], weight="weight", current="current", cap="cap", amount="amount"
        ).collect()
    }
    for group in range(80):
        mine = [r for r in rows if r[0] == group]
        level = {r[1]: r[3] for r in mine}
        brute.pour(
            mine[0][5], [r[1] for r in mine], {r[1]: r[2] for r in mine}, level,
            {r[1]: r[4] for r in mine}, 1e-12,
        )
        for i, value in level.items():
            assert got[group, i] == pytest.approx(value, abs=1e-6)


@pytest.fixture(scope="module")
def values(spark):
    rng = random.Random(9)
    rows = [("hot", rng.choice((rng.gauss(0, 50), float(rng.randint(-3, 3))))) for _ in range(5000)]
    rows += [("one", 2.5), *[("same", 7.0)] * 9, *[("two", v) for v in (-1.0, 4.0)]]
    return spark.createDataFrame(rows, "k string, v double"), rows


def test_window_sums_keep_small_squares_after_large_ones(spark):
    rows = [(0, 0, 0, 0, t, t, 1e12 if t < 50 else 1e-6 * (t % 7 + 1)) for t in range(100)]
    rows = [(r[0], t // 9, *r[2:]) for t, r in enumerate(rows)] + [(1, 3, 0, 0, 1, 1, None), (1, 3, 0, 0, 2, 2, 4.0)]
    schema = "house_id long, cycle long, household_id long, plug_id long, ts_us long, row_id long, sq double"
    events = spark.createDataFrame(rows, schema).repartition(5)
    warm = spark.createDataFrame([(0, 0, 0, 0, 0), (1, 0, 0, 0, 0)], "house_id long, household_id long, plug_id long, last_us long, n long")
    states = cycles.slice_states(events, warm)
    for window in (1, 7, 20, 1000):
        got = {(r.house_id, r.m): r.total for r in score.window_sums(events, states, window).collect()}
        squares = [r[-1] for r in rows if r[0] == 0]
        for m in range(1, 101):
            want = math.fsum(squares[max(0, m - window) : m])
            assert got[0, m] == pytest.approx(want, rel=1e-9, abs=0)
        assert got[1, 1] == 4.0 and len(got) == 101


@pytest.fixture(scope="module")
def narrow(spark):
    """All values of a group in one bucket, most of them equal, others a hair apart."""
    rng = random.Random(4)
    rows = [("near", 5.0 + rng.random() * 1e-3) for _ in range(3000)] + [("near", 5.0005)] * 3000
    rows += [("tight", 7.0 + k * 2.0**-50) for k in range(50)] + [("neg", -3.0 - rng.random() * 1e-9) for _ in range(500)]
    return spark.createDataFrame(rows, "k string, v double"), rows


@pytest.mark.parametrize("given", ["values", "narrow"])
def test_percentiles_are_exact(given, request):
    df, rows = request.getfixturevalue(given)
    probs = {"a": 0.0, "b": 0.05, "c": 0.5, "d": 0.95, "e": 0.99, "f": 1.0}
    found = stats.exact_percentiles(df, ["k"], F.col("v"), probs).collect()
    assert len(found) == len({k for k, _ in rows})
    for r in found:
        mine = [v for k, v in rows if k == r.k]
        for name, p in probs.items():
            assert r[name] == pytest.approx(float(np.quantile(mine, p)), rel=1e-15, abs=1e-12)


def test_percentiles_of_large_cells_are_cut_in_rounds(narrow, monkeypatch):
    monkeypatch.setattr(stats, "CELL_ROWS", 30)
    df, rows = narrow
    found = stats.exact_percentiles(df, ["k"], F.col("v"), {"a": 0.2, "b": 0.5, "c": 0.97}).collect()
    for r in found:
        mine = [v for k, v in rows if k == r.k]
        for name, p in {"a": 0.2, "b": 0.5, "c": 0.97}.items():
            assert r[name] == pytest.approx(float(np.quantile(mine, p)), rel=1e-15, abs=1e-12)


@pytest.mark.parametrize("cell_rows", [100_000, 40])
def test_water_levels_of_large_groups(spark, monkeypatch, cell_rows):
    """Also with all ratios in one cell, all equal, too little and too much water, and rows that take no part."""
    monkeypatch.setattr(water, "CELL_ROWS", cell_rows)
    rng = random.Random(8)
    rows, amounts = [], []

    def group(name, pairs, share):
        rows.extend((name, *p) for p in pairs)
        amounts.append((name, share * sum(r for r, w in pairs if w > 0 and r > 0)))

    near = [(w * (3.0 + rng.random() * 1e-3), w) for w in (rng.random() + 0.1 for _ in range(2000))]
    for share in (0.0, 0.3, 0.9996, 0.9999, 1.0, 2.0):
        group(f"near{share}", near, share)
        group(f"wide{share}", [(rng.expovariate(0.1), rng.random()) for _ in range(300)], share)
    group("equal", [(2.0 * w, float(w)) for w in range(1, 50)], 0.7)
    group("single", [(4.0, 0.5)], 0.5)
    group("partly", [(5.0, 0.0), (0.0, 1.0), (6.0, 1.0), (1.0, 2.0)], 0.8)
    df = spark.createDataFrame(rows, "g string, room double, w double").repartition(6)
    given = spark.createDataFrame(amounts, "g string, amount double")
    found = water.water_levels(df, ["g"], room=F.col("room"), weight=F.col("w"), amounts=given).collect()
    assert len(found) == len(amounts)
    for r in found:
        mine = [(room, w) for g, room, w in rows if g == r.g and room > 0 and w > 0]
        amount = dict(amounts)[r.g]
        spent = math.fsum(min(room, r.level * w) for room, w in mine)
        assert spent == pytest.approx(min(amount, math.fsum(room for room, _ in mine)), rel=1e-9, abs=1e-9), r.g


def test_one_house_of_many_plugs(spark, monkeypatch):
    """The capped allocation in rounds spends what the one in one step spends."""
    rng = random.Random(6)
    rows = [(1, 0, 5, h, p, 0, 1000.0, 0.5, 1.0 + rng.random() * 1e-3) for h in range(3) for p in range(400)]
    schema = "house_id long, cycle long, tick_us long, household_id long, plug_id long, last_us long, mean_load double, sigma_floor double, score double"
    snapshots = spark.createDataFrame(rows, schema)
    q = ", ".join(f"{quantile_name(p)} double" for p in (0.9, 0.95, 0.99))
    quantiles = spark.createDataFrame(
        [(1, h, p, 50, *[0.3 + rng.random()] * 3) for h in range(3) for p in range(400)],
        f"house_id long, household_id long, plug_id long, samples long, {q}",
    )
    config = AllocationConfig("cap", "true_hierarchical_cap", 0.9, cap_fraction=0.25)
    traces = []
    for limit in (100_000, 25):
        monkeypatch.setattr(water, "CELL_ROWS", limit)
        monkeypatch.setattr(stats, "CELL_ROWS", limit)
        trace = alloc.allocate(snapshots, None, quantiles, [config], house_params())
        traces.append({(r.household_id, r.plug_id): r for r in trace.collect()})
    assert len(traces[0]) == len(traces[1]) == 1200
    for key, r in traces[0].items():
        other = traces[1][key]
        assert r.threshold == pytest.approx(other.threshold, rel=1e-9) and r.cap_hit_count == other.cap_hit_count
        assert 0 < r.threshold <= r.cap and r.used_budget == pytest.approx(other.used_budget)
    some = next(iter(traces[0].values()))
    assert some.used_budget == pytest.approx(min(900.0, math.fsum(r.cap for r in traces[0].values())))


def test_counts_above_need_no_second_sort(spark, capsys):
    cells = spark.createDataFrame([("a", 1, 2), ("a", 5, 3), ("a", 9, 4), ("b", 3, 7)], "k string, c int, _n long")
    placed = stats._placed(cells, ["k"], "c", ["_n"])
    assert sorted(tuple(r) for r in placed.select("k", "c", "_before", "_over_n").collect()) == [
        ("a", 1, 0, 7), ("a", 5, 2, 4), ("a", 9, 5, 0), ("b", 3, 0, 0)
    ]
    placed.explain()
    assert "DESC" not in capsys.readouterr().out


@pytest.mark.parametrize("given", ["values", "narrow"])
def test_tail_means_and_top_share(given, request):
    df, rows = request.getfixturevalue(given)
    tails = stats.tail_means(df, ["k"], F.abs("v"), {"cvar": ("p", 0.95)})
    shares = stats.top_share(df, ["k"], F.col("v") * F.col("v"), {"s1": 0.01, "s5": 0.05})
    for r in tails.join(shares, "k").collect():
        mine = np.abs([v for k, v in rows if k == r.k])
        cut = np.quantile(mine, 0.95)
        assert r.cvar == pytest.approx(float(mine[mine >= cut].mean()))
        squares = np.sort(mine**2)[::-1]
        for name, f in (("s1", 0.01), ("s5", 0.05)):
            top = squares[: max(math.ceil(len(squares) * f), 1)].sum()
            assert r[name] == pytest.approx(top / squares.sum() if squares.sum() else 0.0)


def test_running_totals_do_not_depend_on_slices(spark):
    rng = random.Random(1)
    rows = [(i % 3, i, i // 40, rng.uniform(0, 1), i if rng.random() < 0.1 else None)
            for i in range(400)]
    df = spark.createDataFrame(rows, "k long, i long, s long, v double, m long")
    got = stats.running_totals(
        df, ["k"], "s", ["i"], sums={"total": F.col("v")}, maxima={"top": F.col("m")}
    ).collect()
    for r in got:
        before = [x for x in rows if x[0] == r.k and x[1] <= r.i]
        assert r.total == pytest.approx(sum(x[3] for x in before))
        marks = [x[4] for x in before if x[4] is not None]
        assert r.top == (max(marks) if marks else None)


def test_spearman_edge_rules(spark):
    rows = [("same", 1.0, 1.0)] * 3 + [("flat", 1.0, float(i)) for i in range(4)]
    rows += [("up", float(i), float(i * i)) for i in range(6)] + [("down", 1.0, 3.0), ("down", 2.0, 1.0)]
    df = spark.createDataFrame(rows, "k string, a double, b double")
    got = {r.k: r.rho for r in stats.spearman(df, ["k"], "a", "b", "rho").collect()}
    assert got["same"] == 1.0 and got["flat"] == 0.0
    assert got["up"] == pytest.approx(1.0) and got["down"] == pytest.approx(-1.0)


def test_ewma_move():
    assert moved(2, 4, 0.25) == 3 and moved(2, 4, 0) == 2 and moved(2, 4, 1) == 6


def test_detectors_step_by_step():
    z = drift.Detector("zscore_consecutive", z_threshold=2, z_count=2, cooldown=2)
    state, fired, held = drift.CALM, [], []
    for _ in range(5):
        state, fires, kept = drift.observe(state, 3.0, z, True)
        fired.append(fires)
        held.append(kept)
    assert fired == [False, True, False, False, False] or fired == [False, True, False, False, True]
    c = drift.Detector("cusum", kappa=0, threshold_h=2)
    for value, expected in ((3.0, True), (-3.0, True), (0.1, False)):
        assert drift.observe(drift.CALM, value, c, True)[1] is expected
    state, fires, _ = drift.observe(drift.CALM, 9.0, c, False)
    assert not fires and state[1] == 9.0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.floats(-20, 20), min_size=1, max_size=60), st.integers(0, 4))
def test_cusum_never_fires_during_cooldown(series, cooldown):
    detector = drift.Detector("cusum", kappa=0.5, threshold_h=4.0, cooldown=cooldown)
    state, since = drift.CALM, None
    for z in series:
        state, fires, _ = drift.observe(state, z, detector, True)
        assert state[1] >= 0 and state[2] >= 0 and 0 <= state[3] <= cooldown
        if fires:
            assert since is None or since >= cooldown
            since = 0
        elif since is not None:
            since += 1


def test_dominance_and_nearest_match(spark):
    points = spark.createDataFrame(
        [
            (0, "uniform", 1.0, 0.5, 1.0, 1.0, 1.0),
            (0, "uniform", 2.0, 0.3, 2.0, 2.0, 2.0),
            (0, "flat", 1.0, 0.4, 0.9, 1.0, 1.0),
            (0, "flat", 2.0, 0.31, 2.5, 2.5, 2.5),
        ],
        "house_id long, mode string, epsilon double, transmission_ratio double, rmse double, "
        "cvar99 double, max double",
    )
    flags = {
        (r.mode, r.epsilon): r.pareto_dominated for r in compare.with_dominance(points).collect()
    }
    assert flags == {
        ("uniform", 1.0): True, ("uniform", 2.0): False,
        ("flat", 1.0): False, ("flat", 2.0): True,
    }
    matched = {r.mode_epsilon: r for r in compare.matched_transmission(points).collect()}
    assert matched[1.0].matched_uniform_epsilon == 1.0  # a tie goes to the smaller epsilon
    assert matched[2.0].matched_uniform_epsilon == 2.0
    best = compare.best_pick(points, ["house_id"], ["cvar99", "rmse"]).first()
    assert (best["mode"], best.epsilon) == ("flat", 1.0)


def test_order_keys_are_exact_unless_digits_are_given(spark):
    rows = spark.createDataFrame([(0, 2e-12, "a"), (0, 1e-12, "b")], "house_id long, rmse double, mode string")
    assert compare.best_pick(rows, ["house_id"], ["rmse", "mode"]).first()["mode"] == "b"
    assert compare.best_pick(rows, ["house_id"], ["rmse", "mode"], 9).first()["mode"] == "a"
    batches = spark.createDataFrame(
        [("c", 0, 1, 1e-12), ("c", 0, 2, 2e-12)],
        "config_id string, house_id long, ts_us long, abs_house_error double",
    )
    assert metrics.top_batches(batches, 1).first().ts_us == 2
    assert metrics.top_batches(batches, 1, 9).first().ts_us == 1
    points = spark.createDataFrame(
        [(0, 1.0, 0.5 + 2e-12), (0, 2.0, 0.5 + 1e-12)],
        "house_id long, epsilon double, transmission_ratio double",
    )
    target = spark.createDataFrame([(0, 0.5)], "house_id long, transmission_ratio double")
    nearest = lambda **kw: compare.matched_by(target, points, "transmission_ratio", "m_", **kw).first().m_epsilon
    assert nearest() == 2.0 and nearest(digits=9) == 1.0


def test_repeatability_counts_differences(spark):
    left = spark.createDataFrame([(1,), (1,), (2,)], "x long")
    right = spark.createDataFrame([(1,), (2,), (3,)], "x long")
    row = compare.repeatability(left, right).first()
    assert (row.only_left, row.only_right, row.identical) == (1, 1, False)
    assert compare.repeatability(left, left).first().identical


def test_unsafe_runs_raise(spark):
    bad = spark.createDataFrame([("c", 0, False)], "config_id string, house_id long, safety_pass boolean")
    with pytest.raises(RuntimeError, match="safety"):
        metrics.assert_safe(bad)


def test_only_small_tables_are_broadcast(spark):
    """A table of repeated values is far larger than its files: it does not pass through the driver."""
    from bandwise.session import write_through

    rows = write_through(spark.range(200_000).selectExpr("id", "id div 50000 as same", "1.5D as value"), "repeated")
    packed = rows.groupBy("id").agg(F.collect_list(F.struct("same", "value")).alias("packed"))
    large = write_through(spark.range(1_000_000), "large")
    few = write_through(spark.range(3), "few")

    def plan(other):
        return large.join(other, "id")._jdf.queryExecution().executedPlan().toString()

    assert "BroadcastHashJoin" not in plan(packed)
    assert "BroadcastHashJoin" in plan(few)
