"""Tables whose readers and reruns go by commit markers."""

import pytest

from gridmeter.sources import commits as W

KEYS = ["site_name", "year"]
ROWS = [(1, "A b/c", 2020), (2, "A b/c", 2021), (3, None, 2020), (4, "007", None), (5, "-", 2020), (6, "x,=y%", 2020)]


@pytest.fixture
def df(spark):
    return spark.createDataFrame(ROWS, "k int, site_name string, year int")


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_a_killed_attempt_is_not_read_and_written_again(spark, df, tmp_path):
    path = str(tmp_path / "t")
    with pytest.raises(FileNotFoundError):
        W.read_committed(spark, path, KEYS)
    W.committed_write(df.where("year = 2020 AND site_name IS NOT NULL"), path, KEYS)
    killed = W.write_attempt(df, path, KEYS)               # killed before its markers
    assert rows(W.read_committed(spark, path, KEYS)) == rows(df.where("year = 2020 AND site_name IS NOT NULL"))
    assert W.committed_write(df, path, KEYS, dry_run=True) == 3
    assert len(W.committed_write(df, path, KEYS)) == 3
    assert rows(W.read_committed(spark, path, KEYS)) == rows(df)
    assert W.read_committed(spark, path, KEYS).schema == df.schema      # '007' stays a string
    assert W.committed_write(df, path, KEYS) == []
    assert W.sweep(spark, path, keep=[killed]) == 1      # the run that had nothing to write
    assert W.sweep(spark, path) == 1 and rows(W.read_committed(spark, path, KEYS)) == rows(df)


def test_half_set_markers_do_not_count(spark, df, tmp_path):
    path = str(tmp_path / "t")
    attempt = W.write_attempt(df, path, KEYS)
    (tmp_path / "t/_commits" / f".{attempt}").mkdir(parents=True)
    (tmp_path / "t/_commits" / f".{attempt}" / W._marker(("007", None))).touch()
    assert W.committed(spark, path) == {}
    assert len(W.committed_write(df, path, KEYS)) == 6


def test_overwrite_replaces_partitions(spark, df, tmp_path):
    path = str(tmp_path / "t")
    W.committed_write(df, path, KEYS)
    W.committed_write(df.where("site_name = '007'").selectExpr("k + 100 AS k", "site_name", "year"), path, KEYS, overwrite=True)
    got = rows(W.read_committed(spark, path, KEYS))
    assert (104, "007", None) in got and (4, "007", None) not in got and len(got) == 6


def test_empty_frame(spark, df, tmp_path):
    path = str(tmp_path / "t")
    assert W.committed_write(df.limit(0), path, KEYS) == []
    assert W.read_committed(spark, path, KEYS).collect() == []
