"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Every query is run from the raw tables to its last row, after a warm-up on the smallest data.
``BENCH_PARITY=1`` adds the full procedure at the documented size of the original job: 750
series by 80 months, both measures, six refits of 500 trees each (several minutes).
"""

from __future__ import annotations

import json
import os
import time

from panelcast.operators.boosting import Boosting, Training
from panelcast.operators.features import measure_frame
from panelcast.plans.checks import AS_OF, registered
from panelcast.plans.outlook import build_panel, run_outlook
from panelcast.schema import MEASURES
from panelcast.session import local_session
from panelcast.sources.bindings import bound_history
from panelcast.sources.scratch import Scratch

HEADLINE = [
    "monthly_sums",
    "orphan_facts",
    "series_catalog",
    "dense_grid",
    "feature_frame",
    "recursive_predict_fixed",
    "join_measures",
    "publish_replace_slice",
    "publish_partitions",
    "export_csv",
    "ingest_drop",
    "score_month",
    "predict_all_measures",
    "end_to_end",
]


def drain(frame) -> None:
    frame.write.format("noop").mode("overwrite").save()


def parity(spark, sf_dir: str) -> None:
    """All defaults of the job, on nations instead of segments for the first key."""
    scratch = Scratch(spark)
    outlook, _ = run_outlook(
        bound_history(spark, sf_dir, first_key="nation"),
        scratch,
        as_of=AS_OF,
        estimator=Boosting(),
    )
    drain(outlook)


def refit_start(spark, sf_dir: str, n_trees: int = 50) -> float:
    """Seconds for the first trees of one refit at that size, both measures, panel and bins given."""
    scratch = Scratch(spark)
    history = bound_history(spark, sf_dir, first_key="nation")
    panel = build_panel(history, scratch, as_of=AS_OF)
    frames = {m: measure_frame(panel.lagged, m) for m in MEASURES}
    with Training(frames, Boosting(n_trees=n_trees), scratch) as training:
        start = time.perf_counter()
        training.fit()
        return round(time.perf_counter() - start, 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "panelcast-bench")
    spark.sparkContext.setLogLevel("ERROR")
    queries = registered()
    warm_up = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    for name in HEADLINE:
        drain(queries[name](spark, warm_up if os.path.isdir(warm_up) else sf_dir))
    jobs = {name: queries[name] for name in HEADLINE}
    if os.environ.get("BENCH_PARITY"):
        jobs["parity_750x80_500_trees"] = None
    seconds = {}
    for name, query in jobs.items():
        start = time.perf_counter()
        if query is None:
            parity(spark, sf_dir)
        else:
            drain(query(spark, sf_dir))
        seconds[name] = round(time.perf_counter() - start, 3)
    refit = refit_start(spark, sf_dir)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "refit_750x80_first_50_of_500_trees": refit,
                "sf": float(os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
