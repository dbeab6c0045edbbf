"""One CSV file read in byte ranges equals the whole-file reader."""

from __future__ import annotations

import random

import pytest

from tradewind.sources import csv_records


@pytest.fixture()
def ranges_of(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}

    def set_bytes(n):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(n))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield set_bytes
    for k, v in old.items():
        spark.conf.set(k, v)


def whole_file(spark, path):
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


CASES = {
    "plain": 'a,b\n1,x\n2,y\n3,z\n',
    "breaks": 'a,b\n1,"x\ny"\n2,"p\n\n\nq"\n3,"long ' + "line\n" * 40 + 'end"\n4,z\n',
    "escapes": 'a,b\n1,"say ""hi""\n""again"""\n2,""""\n3,"\n"\n4,"""\n"""\n',
    "crlf": 'a,b\r\n1,"x"\r\n2,y\r\n3,"z"\r\n',
    "no last break": 'a,b\n1,"x\ny"\n2,"tail\nwithout end"',
    "empty fields": 'a,b\n,\n1,\n,"x\n"\n\n2,"",\n',
    "commas": 'a,b\n1,"x,\n,y"\n2,"é😀,\n"\n',
    "quoted header": '"a","b c"\n1,"x\ny"\n',
}


@pytest.mark.parametrize("name", CASES)
@pytest.mark.parametrize("size", [13, 10_000])
def test_equals_whole_file(spark, tmp_path, ranges_of, name, size):
    path = tmp_path / "t.csv"
    path.write_bytes(CASES[name].encode())
    ranges_of(size)
    got = csv_records.read_csv(spark, str(path))
    want = whole_file(spark, str(path))
    assert got.columns == want.columns
    assert rows(got) == rows(want)


def test_random_records_many_tasks_and_files(spark, tmp_path, ranges_of):
    rng = random.Random(11)
    for k in range(2):
        with open(tmp_path / f"part{k}.csv", "w", newline="") as f:
            f.write("id,text,n\n")
            for i in range(400):
                text = "".join(rng.choice(["word", " ", '""', "\n", ",", "\r\n" if k else "\n", "é"]) for _ in range(rng.randrange(12)))
                f.write(f'{k}-{i},"{text}",{i}\n')
    ranges_of(700)
    got = csv_records.read_csv(spark, str(tmp_path))
    assert csv_records.read_lines(spark, str(tmp_path)).rdd.getNumPartitions() >= 8
    want = whole_file(spark, str(tmp_path))
    # A whole-file reader takes every record; line ends inside quotes are kept by both.
    assert rows(got) == rows(want) and got.count() == 800


def test_empty_file(spark, tmp_path):
    (tmp_path / "t.csv").write_text("")
    assert csv_records.read_csv(spark, str(tmp_path / "t.csv")).count() == 0
