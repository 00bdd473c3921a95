"""CSV files cut inside quoted cells: the same records as from one task, ids that stay."""

import csv
import random

import pytest

from labelsieve.plans.predict_and_flag import flag_into
from labelsieve.sources.split_csv import csv_records
from labelsieve.sources.tables import read_labelled_csv

CELLS = ["plain", "", 'say "hi"', "two\nlines", "\n\n", ',\n"', 'a\r\nb', "NA", "x" * 70, '"', "é中\n" * 9, "last"]


@pytest.fixture
def small_blocks(spark):
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "97")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    for k, v in kept.items():
        spark.conf.set(k, v)


def write(path, rows, terminator="\n"):
    with open(path, "w", encoding="utf-8", newline="") as f:
        out = csv.writer(f, lineterminator=terminator)
        out.writerow(["n", "text", "more"])
        out.writerows(rows)
    return rows


def cells(seed, n):
    rng = random.Random(seed)
    return [(str(i), rng.choice(CELLS), rng.choice(CELLS)) for i in range(n)]


@pytest.mark.parametrize("terminator", ["\n", "\r\n"])
def test_records_of_many_blocks(spark, tmp_path, small_blocks, terminator):
    one = write(tmp_path / "a.csv", cells(1, 300), terminator)
    two = write(tmp_path / "b.csv", cells(2, 120), terminator)
    write(tmp_path / "c.csv", [])
    assert csv_records(spark, str(tmp_path)).rdd.getNumPartitions() > 1
    back = read_labelled_csv(spark, str(tmp_path), {"n": "int"}, ["text"], row_id="id", split=True).collect()

    def known(cell):
        return None if cell in ("", "NA") else cell

    for name, rows in (("a.csv", one), ("b.csv", two)):
        mine = {r["n"]: (r["text"], r["more"]) for r in back if f"/{name}:" in r["id"]}
        assert mine == {int(n): (known(t), known(m)) for n, t, m in rows}
    assert len({r["id"] for r in back}) == len(back) == 420


def test_as_the_reader_of_one_task(spark, tmp_path, small_blocks):
    write(tmp_path / "a.csv", cells(3, 200))
    whole = read_labelled_csv(spark, str(tmp_path / "a.csv")).collect()
    split = read_labelled_csv(spark, str(tmp_path / "a.csv"), split=True).collect()
    assert sorted(map(tuple, whole), key=repr) == sorted(map(tuple, split), key=repr)


def test_ids_stay_when_files_are_added(spark, tmp_path, small_blocks):
    folder = tmp_path / "in"
    folder.mkdir()
    write(folder / "m.csv", cells(4, 60))

    def ids():
        rows = read_labelled_csv(spark, str(folder), row_id="row_id", split=True).collect()
        return {r["row_id"]: (r["n"], r["text"]) for r in rows}

    first = ids()
    write(folder / "a.csv", cells(5, 80))
    write(folder / "z.csv", cells(6, 10))
    assert first.items() <= ids().items() and len(ids()) == 150


def test_split_ids_serve_for_resuming(spark, tmp_path, small_blocks):
    folder, out = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()

    def load():
        import numpy as np

        return lambda texts: np.stack([texts.str.len().to_numpy("float64"), np.zeros(len(texts))], axis=1)

    def flagged():
        rows = read_labelled_csv(spark, str(folder), row_id="row_id", split=True)
        return flag_into(rows, out, load, {0: "a", 1: "b"}, "m").rows.count()

    write(folder / "m.csv", cells(7, 30))
    assert flagged() == 30
    write(folder / "a.csv", cells(8, 20))
    assert flagged() == 50


def test_an_open_quote_ends_with_its_file(spark, tmp_path, small_blocks):
    (tmp_path / "a.csv").write_text('t\n1\n"open\n' + "more\n" * 50)
    (tmp_path / "b.csv").write_text("t\n2\n3\n")
    records = {(r["file"][-5:], r["number"]): r["record"] for r in csv_records(spark, str(tmp_path)).collect()}
    assert records["b.csv", 1] == "2" and records["b.csv", 2] == "3" and len(records) == 6
    assert records["a.csv", 2].startswith('"open\nmore') and records["a.csv", 2].count("more") == 50
