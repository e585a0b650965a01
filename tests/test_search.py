"""The staged search: every house by its own winners."""

from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from bandwise.operators import splits
from bandwise.params import AdaptiveConfig, AllocationConfig, interval
from bandwise.plans import studies
from bandwise.plans.frozen import Study
from tests.fixtures import SCHEMA, START, drifting_house, house_params


def test_every_house_follows_its_own_winners(spark, monkeypatch):
    monkeypatch.setattr(studies, "ALPHAS", (0.05, 0.4))
    monkeypatch.setattr(studies, "KAPPAS", (0.5,))
    monkeypatch.setattr(studies, "CUSUM_LIMITS", (3.0, 8.0))
    monkeypatch.setattr(studies, "SUPPRESSION_LIMITS", (20, None))
    monkeypatch.setattr(studies, "SILENCE_LIMITS", (3600,))
    # the second house is still, so other candidates win there
    second = [(i, at, 10.0 + v / 40, *rest) for i, at, v, *rest in drifting_house(seed=11, house=5)]
    events = spark.createDataFrame([*drifting_house(house=0), *second], SCHEMA)
    params = house_params(
        validation=interval(START + timedelta(days=1), START + timedelta(hours=35, minutes=59)),
        evaluation=interval(START + timedelta(hours=36), START + timedelta(hours=47, minutes=45)),
    )
    base = AllocationConfig("base", "uniform", 0.05)
    template = AdaptiveConfig(base, detector="cusum")

    search = studies.StagedSearch(
        Study(events, params), base, template, maximum_additional_tr=1.0, maximum_unresolved_fraction=1.0
    )
    rows = search.candidates.collect()
    assert len(rows) == 2 * (2 + 2 + 2 + 1)
    # a house's candidates follow from its own winner of the stage before
    selected = {r.house_id: r for r in search.selected.collect()}
    assert set(selected) == {0, 5}
    kept = {
        "B_cusum": ("alpha",), "C_count": ("alpha", "threshold_h"),
        "C_time": ("alpha", "threshold_h", "max_suppressions"),
    }
    for house in (0, 5):
        winner = None
        for stage in ("A_alpha", *kept):
            mine = [r for r in rows if r.house_id == house and r.stage == stage]
            for field in kept.get(stage, ()):
                assert {r[field] for r in mine} == {winner[field]}
            winner = min(
                (r for r in mine if not r.rejected),
                key=lambda r: (
                    round(r.cvar99, 9), round(r.rmse, 9), round(r["max"], 9), round(r.transmission_ratio, 9),
                    r.drift_trigger_count + r.periodic_sync_trigger_count, r.candidate_id,
                ),
            )
        assert selected[house].candidate_id == winner.candidate_id
    # the winners run on the evaluation interval, one candidate a house
    final = Study(events, house_params(
        warmup=params.warmup, evaluation=params.evaluation,
    ))
    found = search.on(final).decisions.groupBy("house_id").agg(
        F.count("*").alias("n"), F.countDistinct("config_id").alias("configs")
    )
    want = events.where(splits.inside(params.evaluation)).groupBy("house_id").count()
    assert {r.house_id: (r.n, r.configs) for r in found.collect()} == {
        r.house_id: (r["count"], 1) for r in want.collect()
    }
    with pytest.raises(ValueError, match="one allocator that reads no scores"):
        from bandwise.plans.adaptive import AdaptiveRun

        mixed = [template, AdaptiveConfig(AllocationConfig("b", "flat_variance", 0.05))]
        AdaptiveRun(final, mixed, assigned=want)


def test_a_search_without_winners_has_its_judged_candidates(spark, monkeypatch):
    monkeypatch.setattr(studies, "ALPHAS", (0.05,))
    events = spark.createDataFrame(drifting_house(house=0), SCHEMA)
    params = house_params(
        validation=interval(START + timedelta(days=1), START + timedelta(hours=35, minutes=59)),
        evaluation=interval(START + timedelta(hours=36), START + timedelta(hours=47, minutes=45)),
    )
    base = AllocationConfig("base", "uniform", 0.05)
    # nothing may cost anything, not even what saves: all candidates are rejected in the first stage
    search = studies.StagedSearch(
        Study(events, params), base, AdaptiveConfig(base, detector="cusum"), maximum_additional_tr=-2.0
    )
    rows = search.candidates.collect()
    assert [(r.stage, r.rejected, r.rejection_reason) for r in rows] == [("A_alpha", True, "additional_tr_limit")]
    with pytest.raises(ValueError, match="all predictor validation candidates rejected"):
        search.selected  # noqa: B018
