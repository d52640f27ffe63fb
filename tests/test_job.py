"""The job from dropped files to the export."""

import csv
import glob

from panelcast.__main__ import main
from panelcast.plans.job import run_job
from panelcast.schema import HISTORY_LABELS, PUBLISHED_LABELS
from panelcast.sources.tables import read_published
from panelcast.streaming.drop import ingest_drop, read_audit, read_ingested

HEADER = ",".join(HISTORY_LABELS)
SHEETS = {"Departements": "A\nB", "ctt": "c", "typeOpe": "o", "SousTraitance": "p"}


def put(folder, name, *lines):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(lines) + "\n", encoding="utf-8")


def month(i):
    return f"{2020 + i // 12}-{i % 12 + 1:02d}"


def run(tmp_path, as_of):
    main(
        [
            str(tmp_path / "drop"), str(tmp_path / "store"), "--dimensions", str(tmp_path),
            "--as-of", as_of, "--trees", "2", "--retrain", "once",
        ]
    )


def test_two_monthly_runs(spark, tmp_path):
    for sheet, values in SHEETS.items():
        put(tmp_path / sheet, "list.csv", "value", values)
    facts = [f"{month(i)},A,c,o,p,{100 + i},{10 + i}" for i in range(16)]
    put(tmp_path / "drop", "first.csv", HEADER, *facts[:15])
    run(tmp_path, "2021-04-02")
    published = str(tmp_path / "store" / "published")
    rows = {(r.bu, r.month): r for r in read_published(spark, published).collect()}
    assert len(rows) == 2 * (15 + 6)
    assert rows["A", 14].ca == 114.0
    assert rows["A", 15].ca is None and rows["A", 15].ca_pred is not None

    put(tmp_path / "drop", "second.csv", HEADER, *facts)  # the whole history again, one month on
    run(tmp_path, "2021-05-02")
    rows = {(r.bu, r.month): r for r in read_published(spark, published).collect()}
    assert len(rows) == 2 * (16 + 6)
    assert rows["A", 14].ca == 114.0
    assert str(rows["B", 21].period_end) == "2021-10-31"
    audit = read_audit(spark, str(tmp_path / "store" / "audit")).collect()
    assert [r.file_path.rsplit("/", 1)[1] for r in audit] == ["first.csv", "second.csv"]

    (part,) = glob.glob(str(tmp_path / "store" / "export" / "part-*.csv"))
    with open(part, encoding="utf-8") as file:
        exported = list(csv.reader(file))
    assert exported[0] == list(PUBLISHED_LABELS.values())
    assert len(exported) == 1 + 2 * 22


def test_nothing_dropped_yet(spark, tmp_path):
    (tmp_path / "drop").mkdir()
    assert run_job(spark, str(tmp_path / "drop"), str(tmp_path / "store")) is None
    assert not (tmp_path / "store" / "published").exists()


def test_newest_file_or_all(spark, tmp_path):
    put(tmp_path / "drop", "a.csv", HEADER, "2021-01,A,c,o,p,1,1")
    paths = [str(tmp_path / n) for n in ("history", "audit", "progress")]
    ingest_drop(spark, str(tmp_path / "drop"), *paths, fmt="csv", max_files=1)
    put(tmp_path / "drop", "b.csv", HEADER, "2021-01,A,c,o,p,1,1", "2021-02,A,c,o,p,2,2")
    ingest_drop(spark, str(tmp_path / "drop"), *paths, fmt="csv", max_files=1)
    assert read_ingested(spark, paths[0]).count() == 3
    assert read_ingested(spark, paths[0], paths[1]).count() == 2


def test_three_measures_in_another_notation(spark, tmp_path):
    header = ";".join([*HISTORY_LABELS, "units"])
    facts = [f"{month(i)};A;c;o;p;{100 + i},5;{10 + i},25;{i}" for i in range(15)]
    put(tmp_path / "drop", "all.csv", header, *facts)
    store = tmp_path / "store"
    main(
        [
            str(tmp_path / "drop"), str(store), "--as-of", "2021-04-02", "--trees", "2",
            "--retrain", "once", "--sep", ";", "--decimal", ",", "--single-file",
            "--measures", "ca", "mg", "units", "--horizon", "2", "--lags", "3",
        ]
    )
    measures = ["ca", "mg", "units"]
    rows = read_published(spark, str(store / "published"), measures).orderBy("month").collect()
    assert [(r.ca, r.mg, r.units) for r in rows[:2]] == [(100.5, 10.25, 0.0), (101.5, 11.25, 1.0)]
    assert len(rows) == 15 + 2 and all(r.units_pred is not None for r in rows[15:])
    (part,) = glob.glob(str(store / "export" / "part-*.csv"))
    with open(part, encoding="utf-8") as file:
        assert next(csv.reader(file)) == [*PUBLISHED_LABELS.values(), "units", "units_pred"]
