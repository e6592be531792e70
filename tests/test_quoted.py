"""Quoted line breaks by byte ranges against the CSV source."""

import gzip
import random

import pytest

from panelspark.sources import quoted, readers


def table(seed, n):
    rng = random.Random(seed)
    out = ["id\tname\t\"long\nhead\""]
    for i in range(n):
        cell = "".join(rng.choice(["a", "bé", "\n", '""', "\t", " ", "x" * 30, "\n\n"]) for _ in range(rng.randint(0, 12)))
        out.append(f'{i}\t{"w" * rng.randint(0, 40)}\t"{cell}"' if rng.random() < 0.7 else f"{i}\tplain\t{rng.random()}")
        if rng.random() < 0.03:
            out.append(rng.choice(["", f"{i}\ttoo few", f"{i}\ta\tb\ttoo many"]))
    return "\n".join(out) + "\n"


@pytest.fixture
def small_ranges(spark):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "701")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
    spark.conf.set("spark.sql.files.openCostInBytes", old[1])


def same(spark, path):
    got, want = quoted.read(spark, path), readers.delimited(spark, path)
    assert got.columns == want.columns
    key = lambda df: sorted((tuple(r) for r in df.collect()), key=str)
    assert key(got) == key(want)
    return got


def test_equal_to_the_csv_source(spark, tmp_path, small_ranges):
    for seed in range(3):
        (tmp_path / f"f{seed}.tsv").write_text(table(seed, 150))
    same(spark, str(tmp_path / "f0.tsv"))
    assert same(spark, str(tmp_path)).count() > 400
    with gzip.open(tmp_path / "z.tsv.gz", "wt") as f:
        f.write(table(9, 60))
    same(spark, str(tmp_path / "z.tsv.gz"))


def test_a_row_over_several_ranges_and_small_files(spark, tmp_path, small_ranges):
    (tmp_path / "long.csv").write_text('a,b\n1,"' + "line\n" * 900 + '"\n2,"x"\n3,"' + "q\n" * 500 + 'end"')
    assert same(spark, str(tmp_path / "long.csv")).count() == 3
    (tmp_path / "head.csv").write_text("a,b\n")
    assert quoted.read(spark, str(tmp_path / "head.csv")).count() == 0
    (tmp_path / "crlf.csv").write_bytes(b'a,b\r\n1,"x"\r\n2,y\r\n')
    assert sorted(map(tuple, quoted.read(spark, str(tmp_path / "crlf.csv")).collect())) == [("1", "x"), ("2", "y")]
