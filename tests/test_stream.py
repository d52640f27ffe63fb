import os
import time

import pytest

from panelcast.schema import HISTORY_LABELS
from panelcast.sources.tables import read_dimensions, read_history
from panelcast.streaming.drop import ingest_drop, read_audit, read_ingested

HEADER = ",".join(HISTORY_LABELS)


@pytest.fixture
def place(tmp_path):
    drop = tmp_path / "drop"
    drop.mkdir()
    return drop, [str(tmp_path / n) for n in ("history", "audit", "progress")]


def put(drop, name, *lines, header=HEADER):
    (drop / name).write_text("\n".join([header, *lines]) + "\n", encoding="utf-8")


def test_files_are_taken_up_once(spark, place):
    drop, paths = place
    put(drop, "b.csv", "2021-01,A,c,o,p,1.5,0.5", "2021-02,A,c,o,p,,0")
    ingest_drop(spark, str(drop), *paths, fmt="csv")
    ingest_drop(spark, str(drop), *paths, fmt="csv")
    assert read_ingested(spark, paths[0]).count() == 2
    put(drop, "a.csv", "2021-03,A,c,o,p,2,1")
    ingest_drop(spark, str(drop), *paths, fmt="csv")
    rows = sorted(read_ingested(spark, paths[0]).collect())
    assert [(r.periode, None if r.ca is None else float(r.ca)) for r in rows] == [
        ("2021-01", 1.5), ("2021-02", None), ("2021-03", 2.0),
    ]
    audit = read_audit(spark, paths[1]).collect()
    assert [r.file_path.rsplit("/", 1)[1] for r in audit] == ["a.csv", "b.csv"]
    assert [r.batch_id for r in audit] == [1, 0]
    assert audit[0].file_size == (drop / "a.csv").stat().st_size
    assert sorted(p.name for p in drop.iterdir()) == ["a.csv", "b.csv"]


def test_empty_directory_is_a_no_op(spark, place):
    drop, paths = place
    ingest_drop(spark, str(drop), *paths, fmt="csv")
    put(drop, "a.csv", "2021-01,A,c,o,p,1,1")
    ingest_drop(spark, str(drop), *paths, fmt="csv")
    assert read_ingested(spark, paths[0]).count() == 1


def test_backlog_in_several_batches(spark, place):
    drop, paths = place
    for i in range(5):
        put(drop, f"{i}.csv", f"2021-0{i + 1},A,c,o,p,{i},0")
    ingest_drop(spark, str(drop), *paths, fmt="csv", max_files=2)
    assert read_ingested(spark, paths[0]).count() == 5
    assert {r.batch_id for r in read_audit(spark, paths[1]).collect()} == {0, 1, 2}


def test_any_name_any_column_order(spark, place):
    drop, paths = place
    header = "note,mg mois,ca mois,pthrough ?,opé,ctt,bu,période"
    put(drop, "ventes [1] {é}*.csv", "x,0.5,1.5,p,o,c,A,2021-01", header=header)
    put(drop, "empty.csv")
    ingest_drop(spark, str(drop), *paths, fmt="csv", max_files=1)
    (row,) = read_ingested(spark, paths[0]).collect()
    assert (row.periode, row.bu, float(row.ca), float(row.mg)) == ("2021-01", "A", 1.5, 0.5)
    assert read_audit(spark, paths[1]).count() == 2


@pytest.mark.parametrize("max_files", [1, 1000])
def test_files_of_a_batch_need_not_agree(spark, place, max_files):
    drop, paths = place
    put(drop, "a.csv", "2021-01,A,c,o,p,1,9")
    header = "mg mois,période,bu,ctt,opé,pthrough ?,ca mois"
    put(drop, "b.csv", "9,2021-01,A,c,o,p,1", header=header)
    ingest_drop(spark, str(drop), *paths, fmt="csv", max_files=max_files)
    rows = read_ingested(spark, paths[0]).collect()
    assert [(r.periode, float(r.ca), float(r.mg)) for r in rows] == [("2021-01", 1.0, 9.0)] * 2


def test_old_files_count_as_new(spark, place):
    drop, paths = place
    for i, days in enumerate([0, 10, 4000, 0]):
        put(drop, f"{i}.csv", f"2021-0{i + 1},A,c,o,p,{i},0")
        then = time.time() - days * 86_400
        os.utime(drop / f"{i}.csv", (then, then))
        ingest_drop(spark, str(drop), *paths, fmt="csv")
        assert read_ingested(spark, paths[0]).count() == i + 1
    assert read_audit(spark, paths[1]).count() == 4


def test_only_the_newest_of_a_backlog_is_stored(spark, place):
    drop, paths = place
    for i, days in enumerate([5, 1, 3]):
        put(drop, f"{i}.csv", f"2021-0{i + 1},A,c,o,p,{i},0")
        then = time.time() - days * 86_400
        os.utime(drop / f"{i}.csv", (then, then))
    ingest_drop(spark, str(drop), *paths, fmt="csv", newest_only=True)
    assert [r.periode for r in read_ingested(spark, *paths[:2]).collect()] == ["2021-02"]
    assert read_audit(spark, paths[1]).count() == 3


def test_semicolons_and_decimal_commas(spark, place):
    drop, paths = place
    put(drop, "a.csv", "2021-01;A;c;o;p;1,5;-0,25", header=HEADER.replace(",", ";"))
    options = {"sep": ";", "decimal": ","}
    ingest_drop(spark, str(drop), *paths, fmt="csv", reader_options=options)
    (row,) = read_ingested(spark, paths[0]).collect()
    assert (float(row.ca), float(row.mg)) == (1.5, -0.25)


def test_missing_column_fails(spark, place):
    drop, paths = place
    put(drop, "a.csv", "2021-01,A,c,o,p,1", header=HEADER.rsplit(",", 1)[0])
    with pytest.raises(Exception, match="mg mois"):
        ingest_drop(spark, str(drop), *paths, fmt="csv")


def test_malformed_file_fails_and_can_be_repeated(spark, place):
    drop, paths = place
    put(drop, "a.csv", "2021-01,A,c,o,p,many,1")
    with pytest.raises(Exception):
        ingest_drop(spark, str(drop), *paths, fmt="csv")
    put(drop, "a.csv", "2021-01,A,c,o,p,3,1")
    ingest_drop(spark, str(drop), *paths, fmt="csv")
    assert [float(r.ca) for r in read_ingested(spark, paths[0]).collect()] == [3.0]


def test_history_is_projected_by_name(spark, tmp_path):
    header = "id,période,mg mois,bu,ctt,opé,pthrough ?,ca mois"
    put(tmp_path, "h.csv", "x,2021-1,9,A,c,o,p,8", header=header)
    row = read_history(spark, str(tmp_path / "h.csv"), "csv").first()
    assert (row.periode, row.bu, float(row.ca), float(row.mg)) == ("2021-1", "A", 8.0, 9.0)
    put(tmp_path, "short.csv", "2021-1,A", header="période,bu")
    with pytest.raises(Exception, match="ctt"):
        read_history(spark, str(tmp_path / "short.csv"), "csv")


def test_reader_options(spark, tmp_path):
    lines = ["\ufeff" + HEADER.replace(",", ";"), '2021-1;"A;""1""";c;o;p;8;9']
    (tmp_path / "h.csv").write_text("\n".join(lines) + "\n", encoding="utf-8")
    row = read_history(spark, str(tmp_path / "h.csv"), "csv", sep=";").first()
    assert (row.periode, row.bu, float(row.mg)) == ("2021-1", 'A;"1"', 9.0)


def test_dimension_lists(spark, tmp_path, scratch):
    for sheet, label, values in [
        ("Departements", "bu", ["Z", "A"]),
        ("ctt", "ctt", ["c"]),
        ("typeOpe", "ope", ["o"]),
    ]:
        members = spark.createDataFrame([(v,) for v in values], f"`{label}` string")
        members.coalesce(1).write.parquet(str(tmp_path / sheet))
    spark.createDataFrame([("N", 1), ("O", 0)], "`pthrough ?` string, ord int").write.parquet(
        str(tmp_path / "SousTraitance")
    )
    lists = read_dimensions(spark, str(tmp_path), scratch)
    assert sorted(map(tuple, lists.collect())) == [
        ("bu", "A", 0), ("bu", "Z", 1), ("ctt", "c", 0), ("ope", "o", 0),
        ("pthrough", "N", 1), ("pthrough", "O", 0),
    ]
