"""One large file is inspected and read by many tasks, with results like the plain reader's."""

import csv
import random

import pytest

from emberday.sources import csv_files as C


def _rows(n, breaks):
    rng = random.Random(5)
    texts = ["plain", 'said "so"', "a,b", "한국어", "", " x "] + (["two\nlines", 'three\n"odd"\nlines', "\n"] if breaks else [])
    return [[str(i), rng.choice(texts), rng.choice(texts), str(rng.random())] for i in range(n)]


def _write(path, rows, encoding="utf-8"):
    with open(path, "w", encoding=encoding, newline="") as f:
        csv.writer(f, lineterminator="\n").writerows([["STN", "note", "note2", "TA"], *rows])


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("breaks", [False, True])
@pytest.mark.parametrize("encoding", ["utf-8", "cp949"])
def test_equal_to_the_csv_module(spark, tmp_path, small_splits, breaks, encoding):
    rows = _rows(6000, breaks)
    _write(tmp_path / "a.csv", rows, encoding)
    _write(tmp_path / "b.csv", rows[:3], encoding)
    frame = C.read_csv_folder(spark, str(tmp_path))
    assert breaks or frame.rdd.getNumPartitions() > 4
    assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 4  # what inspection and joining run over
    got = sorted(((r["__source_file"], r.STN, r.note or "", r.note2 or "", r.TA) for r in frame.collect()))
    # blanks around a value are the reader's affair in both forms
    assert got == sorted((f, a, b, c, d) for f, part in (("a.csv", rows), ("b.csv", rows[:3])) for a, b, c, d in part)


def test_joined_records_equal_the_multiline_reader(spark, tmp_path, small_splits):
    _write(tmp_path / "a.csv", _rows(3000, True))
    whole = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(str(tmp_path / "a.csv"))
    split = C.read_csv_folder(spark, str(tmp_path)).drop("__source_file")
    assert sorted(map(str, whole.collect())) == sorted(map(str, split.collect()))


def test_inspection_is_shared_and_right(spark, tmp_path, small_splits):
    _write(tmp_path / "late.csv", [*_rows(4000, False), ["1", "한국어", "", "2"]], "cp949")
    _write(tmp_path / "plain.csv", [["1", "x", "y", "2"]])
    (tmp_path / "empty.csv").write_bytes(b"")
    with open(tmp_path / "head.csv", "w") as f:
        f.write('"S\nT",b\n1,2\n')
    got = {r.path.rsplit("/", 1)[1]: (r.header, r.encoding, r.spans_lines) for r in C.file_headers(spark, str(tmp_path)).collect()}
    assert got == {
        "late.csv": ("STN,note,note2,TA", "cp949", False),
        "plain.csv": ("STN,note,note2,TA", "UTF-8", False),
        "head.csv": ('"S\nT",b', "UTF-8", True),
    }
