"""Headline queries; prints one JSON line.

A replayed event is one evaluation event decided under one configuration, loading included.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession  # noqa: E402

from bandwise import configure  # noqa: E402
from bandwise.plans.frozen import Study  # noqa: E402
from bandwise.plans.studies import (  # noqa: E402
    EPSILONS,
    PARETO_MODES,
    PredictorComparison,
    compare_modes,
    pareto_sweep,
)
from checks import queries as q  # noqa: E402

# the study's epsilon grid, scaled to the spread of the given values
SWEEP = tuple(100 * e for e in EPSILONS)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = configure(
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bandwise-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    events = q.accepted(spark, sf_dir)
    study = Study(events, q.PARAMS)
    timings: dict[str, float] = {}
    replayed = 0

    def timed(name, build):
        begin = time.perf_counter()
        build().write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - begin, 3)

    timed("fit_and_snapshots", lambda: study.snapshots)
    timed("six_modes", lambda: compare_modes(study, q.EPSILON, **q.CAPS).summary())
    timed("pareto_36", lambda: pareto_sweep(study, SWEEP, PARETO_MODES, **q.CAPS))
    timed(
        "five_predictors",
        lambda: PredictorComparison(study, q.BASE, q.TEMPLATE, q.SILENT_LIMIT).rows,
    )
    for name in ("event_scores", "waterfill", "cvar", "activity_spells", "detect_drift_cusum"):
        function = q.registry()[name]
        q._MEMO[(spark.sparkContext.applicationId, sf_dir, f"study-{hash(q.PARAMS)}")] = study
        timed(name, lambda function=function: function(spark, sf_dir))

    count = study.evaluation.count()
    replayed = count * (6 + len(SWEEP) * len(PARETO_MODES) + 5)
    replay_seconds = sum(
        timings[n] for n in ("fit_and_snapshots", "six_modes", "pareto_36", "five_predictors")
    )
    print(
        json.dumps(
            {
                "metric": "headline queries, total wall time",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
                "evaluation_events": count,
                "replayed_events_per_sec": round(replayed / replay_seconds, 1),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
