"""Shared folder and broadcast bounds."""

from types import SimpleNamespace

import pytest

from cohortloom import staging


def test_folder_comes_from_the_session(spark):
    assert staging.shared_folder(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")
    df = staging.stage(spark.range(5), "numbers")
    assert staging.shared_folder(spark) + "/cohortloom/" in df.inputFiles()[0]


def test_no_local_folder_on_a_cluster():
    session = SimpleNamespace(
        conf=SimpleNamespace(get=lambda key, default: default),
        sparkContext=SimpleNamespace(master="spark://host:7077", applicationId="app"))
    with pytest.raises(RuntimeError):
        staging.shared_folder(session)


def test_broadcast_only_below_the_bound(spark):
    def plan(df):
        return df._jdf.queryExecution().analyzed().toString()

    assert "broadcast" in plan(staging.broadcast_if_small(spark.range(10), 10))
    assert "broadcast" not in plan(staging.broadcast_if_small(spark.range(11), 10))


def test_empty_table(spark):
    empty = staging.stage(spark.range(0), "empty")
    assert empty.count() == 0 and empty.columns == ["id"]


def test_discard(spark):
    first = staging.stage(spark.range(3), "first")
    derived = first.where("id > 0")
    staging.discard(derived)
    assert derived.count() == 2
    staging.discard(first)
    with pytest.raises(Exception):
        first.count()


def test_scratch_deletes_what_is_not_kept(spark):
    with staging.scratch() as kept:
        first, second = staging.stage(spark.range(3), "first"), staging.stage(spark.range(4), "second")
        kept.append(second)
    assert second.count() == 4
    with pytest.raises(Exception):
        first.count()
    with staging.scratch():
        with staging.scratch() as kept:
            inner = staging.stage(spark.range(5), "inner")
            kept.append(inner)
        assert inner.count() == 5
    with pytest.raises(Exception):
        inner.count()


def test_own_folder_only_in_local_mode():
    session = SimpleNamespace(
        conf=SimpleNamespace(get=lambda key, default: default),
        sparkContext=SimpleNamespace(master="local-cluster[2,1,1024]", applicationId="app"))
    with pytest.raises(RuntimeError):
        staging.shared_folder(session)
