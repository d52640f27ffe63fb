"""``spark-submit`` entry: python -m panelcast DROP STORE [options]."""

from __future__ import annotations

import argparse
import datetime as dt

from pyspark.sql import SparkSession

from panelcast.operators.boosting import Boosting
from panelcast.plans.job import run_job
from panelcast.schema import HORIZON, MEASURES, N_LAGS


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="panelcast", description=run_job.__doc__)
    parser.add_argument("drop_dir", help="directory new history files are dropped into")
    parser.add_argument("store", help="directory of the history, published and exported tables")
    parser.add_argument("--dimensions", help="directory of the four dimension lists")
    parser.add_argument("--format", default="csv", choices=["csv", "parquet"])
    parser.add_argument("--as-of", type=dt.date.fromisoformat, help="YYYY-MM-DD, today if absent")
    parser.add_argument("--add-files", action="store_true", help="files add to one another")
    parser.add_argument("--replace-from", default="current", choices=["current", "last"])
    parser.add_argument("--retrain", default="each_step", choices=["each_step", "once"])
    parser.add_argument("--trees", type=int, default=500)
    parser.add_argument("--measures", nargs="+", default=list(MEASURES))
    parser.add_argument("--horizon", type=int, default=HORIZON)
    parser.add_argument("--lags", type=int, default=N_LAGS)
    parser.add_argument("--calendar", default="contiguous", choices=["observed", "contiguous"])
    parser.add_argument("--sep", help="separator of the dropped files")
    parser.add_argument("--encoding", help="encoding of the dropped files")
    parser.add_argument("--decimal", help="decimal mark of the dropped files")
    parser.add_argument("--single-file", action="store_true", help="export one file of any length")
    options = parser.parse_args(argv)
    given = {name: getattr(options, name) for name in ("sep", "encoding", "decimal")}
    spark = SparkSession.builder.appName("panelcast").getOrCreate()
    run_job(
        spark,
        options.drop_dir,
        options.store,
        options.dimensions,
        options.format,
        not options.add_files,
        options.as_of,
        options.replace_from,
        options.retrain,
        Boosting(n_trees=options.trees, n_lags=options.lags),
        {name: value for name, value in given.items() if value is not None},
        options.single_file,
        options.measures,
        horizon=options.horizon,
        n_lags=options.lags,
        calendar_mode=options.calendar,
    )


if __name__ == "__main__":
    main()
