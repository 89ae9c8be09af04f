"""Shuffle files of staged tables do not wait for the driver's garbage collection."""

import time

from cohortloom import staging


def shuffle_files(spark):
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for name in (blocks.apply(k).getName() for k in range(blocks.size())) if name.startswith("shuffle")}


def test_shuffles_go_with_the_write(spark):
    before = shuffle_files(spark)
    kept = spark.conf.get(staging.SHUFFLE_CLEANUP)
    summed = spark.range(20_000).selectExpr("id % 700 AS k", "id AS v").groupBy("k").sum("v")
    staged = staging.stage(summed.repartition(3, "k"), "sums")
    for _ in range(50):
        left = shuffle_files(spark) - before
        if not left:
            break
        time.sleep(0.1)
    assert not left
    assert spark.conf.get(staging.SHUFFLE_CLEANUP) == kept
    # Neither the staged table nor the one it was made of needs them.
    assert staged.count() == summed.count() == 700
