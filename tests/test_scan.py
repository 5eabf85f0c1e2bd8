"""Blocked running values equal plain windows, also when one key holds most rows."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from pixelweave.functions import scan


@pytest.fixture(scope="module")
def rows(spark):
    # key 0 holds nine tenths of the rows
    return spark.range(2000).select(
        F.when(F.col("id") % 10 < 9, 0).otherwise(F.col("id") % 3 + 1).alias("k"),
        F.col("id").alias("n"),
        F.pmod(F.xxhash64("id"), F.lit(100)).alias("v"),
    ).withColumn("maybe", F.when(F.col("v") > 60, F.col("v")))


def both(rows, blocked):
    w = Window.partitionBy("k").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    plain = rows.select(
        "k", "n", F.sum("v").over(w).alias("s"), F.min("v").over(w).alias("lo"), F.max("v").over(w).alias("hi"),
        F.last("maybe", ignorenulls=True).over(w).alias("last"),
    )
    values = {"s": ("sum", F.col("v")), "lo": ("min", F.col("v")), "hi": ("max", F.col("v")), "last": ("last", F.col("maybe"))}
    got = scan.running(blocked, ["k"], ["n"], values).select("k", "n", "s", "lo", "hi", "last")
    return sorted(map(tuple, plain.collect())), sorted(map(tuple, got.collect()))


def test_running_number_blocks(rows):
    want, got = both(rows, scan.number_blocks(rows, "n", 128))
    assert got == want


def test_running_range_blocks(rows):
    blocked = scan.range_blocks(rows, ["k"], [F.col("n")], 7)
    sizes = [r["count"] for r in blocked.groupBy("k", scan.BLOCK).count().filter("k = 0").collect()]
    assert len(sizes) >= 5  # the big key is spread
    want, got = both(rows, blocked)
    assert got == want


def test_previous(rows):
    w = Window.partitionBy("k").orderBy("n")
    want = sorted(map(tuple, rows.select("k", "n", F.lag("v").over(w)).collect()), key=str)
    got = scan.previous(scan.number_blocks(rows, "n", 50), ["k"], ["n"], {"p": F.col("v")}).select("k", "n", "p")
    assert sorted(map(tuple, got.collect()), key=str) == want


def test_result_does_not_depend_on_partitions(rows):
    for n in (1, 3, 16):
        want, got = both(rows, scan.range_blocks(rows.repartition(n), ["k"], [F.col("n")], n + 1))
        assert got == want
