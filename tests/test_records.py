"""Records of delimited text against Python's own reader, however files are split."""

import csv
import io
import random

import pytest

from catalog_fusion.sources import records, scan


@pytest.fixture
def split_size(spark):
    def use(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")

    yield use
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def written(path, rows, sep=",", end="\n"):
    out = io.StringIO(newline="")
    csv.writer(out, delimiter=sep, lineterminator=end).writerows(rows)
    path.write_bytes(out.getvalue().encode())
    return str(path)


def read(spark, path, **more):
    return sorted(tuple(v or "" for v in r) for r in scan.scan_text(spark, path, **more).collect())


def table(seed, count):
    rng = random.Random(seed)
    cell = lambda: "".join(rng.choice(["a", "b", ",", '"', "\n", " ", "é", '"\n"', "x" * 30]) for _ in range(rng.randrange(6)))
    return [(str(i), cell(), cell(), "end") for i in range(count)]


@pytest.mark.parametrize("size", [70, 400, 1 << 20])
def test_quoted_breaks_at_every_split(spark, tmp_path, split_size, size):
    rows = table(size, 40 if size < 100 else 300)
    path = written(tmp_path / "t.csv", [("i", "a", "b", "c"), *rows])
    split_size(size)
    assert read(spark, path) == sorted(rows)


def test_breaks_of_all_kinds_and_many_files(spark, tmp_path, split_size):
    folder = tmp_path / "t.tsv"
    folder.mkdir()
    for n, end in enumerate(("\n", "\r\n")):
        rows = [(f"{n}-{i}", "one\ntwo\n\nthree" * (i % 3), '"quoted"' if i % 2 else "") for i in range(50)]
        written(folder / f"{n}.tsv", [("i", "a", "b"), *rows], "\t", end)
    split_size(100)
    want = [(f"{n}-{i}", "one\ntwo\n\nthree" * (i % 3), '"quoted"' if i % 2 else "") for n in range(2) for i in range(50)]
    assert read(spark, str(folder)) == sorted(want)


def test_a_cell_over_many_splits_and_one_that_never_ends(spark, tmp_path, split_size):
    rows = [("1", "x"), ("2", "line\n" * 500), ("3", "y"), ("4", "more\n" * 300 + "z"), ("5", "w")]
    path = written(tmp_path / "t.csv", [("i", "a"), *rows])
    split_size(200)
    assert read(spark, path) == rows
    (tmp_path / "open.csv").write_text('i,a\n1,x\n2,"never\nends\n')
    assert read(spark, str(tmp_path / "open.csv"))[0] == ("1", "x")


def test_a_header_over_many_splits(spark, tmp_path, split_size):
    rows = [(str(i), "x\ny") for i in range(30)]
    path = written(tmp_path / "t.csv", [("i", "long\n" * 40 + "name"), *rows])
    split_size(64)
    found = scan.scan_text(spark, path)
    assert found.columns == ["i", "long\n" * 40 + "name"]
    assert sorted(map(tuple, found.collect())) == sorted(rows)


def test_stray_quotes_are_text(spark, tmp_path, split_size):
    (tmp_path / "t.csv").write_text('i,a,b\n' + "".join(f'{i},5" disk,say "no"\n' for i in range(200)))
    split_size(300)
    assert read(spark, str(tmp_path / "t.csv")) == sorted((str(i), '5" disk', 'say "no"') for i in range(200))


def test_one_line_at_a_time():
    inside = lambda line, begun=False: records.ends_inside(line, begun, ",")
    assert not inside("a,b") and not inside('"a","b"') and inside('a,"b') and inside('"a""') and not inside('"a"""')
    assert not inside('b",c', True) and inside('b",c,"d', True) and inside('b"",c', True) and not inside('x"y,z') and not inside('"a"x"y,z')
    assert inside("", True) and not inside("")


def test_a_large_file_with_breaks_is_split(spark, tmp_path, split_size):
    """One file of 200 MB: text is read in many tasks, once, and every record is whole."""
    line = "word " * 1200
    with open(tmp_path / "big.csv", "w") as out:
        out.write("i,a\n")
        for i in range(200 * 1024 * 1024 // 12_000):
            out.write(f'{i},"{line}\n{line}"\n')
    split_size(16 << 20)
    found = scan.scan_text(spark, str(tmp_path / "big.csv"))
    row = found.selectExpr("count(*) AS n", "count(DISTINCT i) AS ids", "min(length(a)) AS low", "max(length(a)) AS high").first()
    assert row["n"] == row["ids"] == 200 * 1024 * 1024 // 12_000 and row["low"] == row["high"] == 12_001
    assert len([f for f in found.inputFiles() if "/first/" in f]) > 4
