"""Splitting quoted CSV against the reader of whole files."""

import io
import random

import pyarrow as pa
import pytest
from pyspark.sql import types as T

from rankarena.plans import catalog
from rankarena.sources import quoted_csv, sinks, tables

COLUMNS = T.StructType([T.StructField("k", T.IntegerType()), T.StructField("a", T.StringType()), T.StructField("b", T.StringType())])


def odd_rows(seed, count=80):
    rng = random.Random(seed)
    parts = ['"', '""', "\n", "\r\n", ",", "é", "日本", " ", "x", "\\", "plain words", '",\n"', "\n\n", "'"]
    for k in range(count):
        a, b = ("".join(rng.choice(parts) for _ in range(rng.randint(0, 8))) for _ in range(2))
        yield (k, a or None, b or "b")


def written_csv(spark, tmp_path, rows, files=1):
    path = str(tmp_path / "table")
    sinks.write_csv_table(spark.createDataFrame(rows, COLUMNS).coalesce(files) if files == 1 else spark.createDataFrame(rows, COLUMNS).repartition(files), path)
    return path


def as_rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize(("range_bytes", "files"), [(1, 1), (7, 1), (64, 3), (1000, 2), (1 << 20, 1)])
def test_ranges_give_the_rows_of_the_whole_file_reader(spark, tmp_path, range_bytes, files):
    rows = list(odd_rows(range_bytes, 12 if range_bytes == 1 else 80))
    path = written_csv(spark, tmp_path, rows, files)
    whole = tables.read_csv_table(spark, path, COLUMNS)
    split = quoted_csv.read_quoted_csv(spark, path, COLUMNS, range_bytes=range_bytes)
    assert as_rows(split) == as_rows(whole)
    assert as_rows(split) == sorted(rows, key=str)


def test_one_file_is_read_by_many_tasks(spark, tmp_path):
    path = written_csv(spark, tmp_path, list(odd_rows(1, 400)))
    records = quoted_csv.read_records(spark, path, range_bytes=500)
    assert records.rdd.getNumPartitions() > 10
    assert records.count() == 400


def test_records_of_ranges_are_those_of_the_file(monkeypatch):
    """Any ranges and chunks, against a plain scan."""
    rng = random.Random(3)
    for _ in range(200):
        body = "".join(rng.choice(['"', "\n", "a", ",", "\r\n", "bc", '""']) for _ in range(rng.randint(0, 60))).encode()
        plain, begin, quoted = [], 0, False
        for k, byte in enumerate(body):
            if byte == ord('"'):
                quoted = not quoted
            elif byte == ord("\n") and not quoted:
                plain.append((begin, body[begin:k].removesuffix(b"\r")))
                begin = k + 1
        if begin < len(body):
            plain.append((begin, body[begin:].removesuffix(b"\r")))
        monkeypatch.setattr(quoted_csv, "_CHUNK", rng.choice([1, 3, 10, 1000]))
        size = rng.choice([1, 2, 5, 17, 100])
        found = []
        for start in range(0, len(body), size):
            inside = body[:start].count(b'"') % 2 == 1
            found += quoted_csv.records_from(pa.PythonFile(io.BytesIO(body), "r"), start, min(start + size, len(body)), len(body), inside)
        assert found == plain


def test_header_and_empty_files(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.csv").write_text('1,"x\ny",z\n\n2,,"q"\n')
    (tmp_path / "t" / "b.csv").write_text("")
    found = quoted_csv.read_quoted_csv(spark, str(tmp_path / "t"), COLUMNS, header=False, range_bytes=4)
    assert as_rows(found) == [(1, "x\ny", "z"), (2, None, "q")]


def test_pair_tables_come_back(spark):
    sf_dir = "/root/testdata/sf0.001"
    for name, source in (("csv_improvements", "improvement_pairs"), ("csv_tops", "top_pairs")):
        back, direct = getattr(catalog, name)(spark, sf_dir), getattr(catalog, source)(spark, sf_dir)
        assert back.columns == direct.columns
        assert as_rows(back) == as_rows(direct)
