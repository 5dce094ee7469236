"""Ordered helpers against plain windows, with one key that holds most rows."""

from __future__ import annotations

import pytest
from conftest import rows
from pyspark.sql import Window
from pyspark.sql import functions as F

from filmloom.plans.ordering import number_rows, running, with_halo


@pytest.fixture(scope="module")
def skewed(spark):
    """900 of 1,000 rows belong to key 0; values have gaps and nulls."""
    return spark.range(1000).select(
        F.when(F.col("id") < 900, 0).otherwise(F.col("id") % 7 + 1).alias("k"),
        (F.col("id") * 7919 % 1009).alias("t"),
        F.when(F.col("id") % 5 == 0, F.col("id") % 13).alias("v"),
    )


@pytest.mark.parametrize("size", [1, 10, 5000])
def test_number_rows(skewed, size):
    got = number_rows(skewed, ["k"], ["t"], [F.floor(F.col("t") / size)], "pos", total="n")
    w = Window.partitionBy("k")
    want = skewed.withColumns({"pos": F.row_number().over(w.orderBy("t")) - 1, "n": F.count(F.lit(1)).over(w)})
    assert rows(got, "k", "t", "pos", "n") == rows(want, "k", "t", "pos", "n")


def test_number_rows_over_everything(skewed):
    got = number_rows(skewed, [], ["t"], [F.floor(F.col("t") / 100)], "pos")
    assert sorted(r[0] for r in rows(got, "pos")) == list(range(1000))
    assert [r.pos for r in got.orderBy("t").collect()] == list(range(1000))


@pytest.mark.parametrize("size", [3, 64, 5000])
def test_running(skewed, size):
    got = running(
        skewed, ["k"], "t", F.floor(F.col("t") / size), total=("sum", F.col("v")), top=("max", F.col("v")),
        before=("max_before", F.col("v")), kept=("last", F.col("v")),
    )
    w = Window.partitionBy("k").orderBy("t")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    want = skewed.select(
        "k", "t", F.coalesce(F.sum("v").over(upto), F.lit(0)).alias("total"), F.max("v").over(upto).alias("top"),
        F.max("v").over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("before"), F.last("v", True).over(upto).alias("kept"),
    )
    columns = ["k", "t", "total", "top", "before", "kept"]
    assert rows(got, *columns) == rows(want, *columns)


@pytest.mark.parametrize("size", [4, 10, 1000])
def test_halo_gives_the_same_neighbours(spark, size):
    base = spark.range(500).select((F.col("id") % 2).alias("k"), F.floor(F.col("id") / 2).alias("i"))
    w = Window.partitionBy("k", "segment").orderBy("i")
    got = with_halo(base, "i", size, before=2, after=3).withColumns(
        {"a": F.sum("i").over(w.rowsBetween(-2, -1)), "b": F.sum("i").over(w.rowsBetween(1, 3))}
    ).filter("is_own")
    p = Window.partitionBy("k").orderBy("i")
    want = base.withColumns({"a": F.sum("i").over(p.rowsBetween(-2, -1)), "b": F.sum("i").over(p.rowsBetween(1, 3))})
    assert rows(got, "k", "i", "a", "b") == rows(want, "k", "i", "a", "b")


def test_halo_longer_than_segment_is_refused(spark):
    with pytest.raises(ValueError, match="halo"):
        with_halo(spark.range(3), "id", 2, before=3)


def test_no_task_holds_a_whole_hot_key(skewed):
    """The window's partitions are buckets, so the largest one is far below the hot key's 900 rows."""
    tagged = skewed.withColumn("bucket", F.floor(F.col("t") / 50))
    assert tagged.groupBy("k", "bucket").count().agg(F.max("count")).first()[0] <= 50
    plan = number_rows(skewed, ["k"], ["t"], [F.floor(F.col("t") / 50)])._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "SinglePartition" not in plan


@pytest.fixture(scope="module")
def holes(spark):
    """Null keys, null orders and both, with orders that do not repeat inside a key."""
    data = [(i % 4 if i % 11 else None, i if i % 97 else None, i % 7 if i % 3 else None) for i in range(1, 800)]
    kept, seen = [], set()
    for k, t, v in data:
        if t is not None or k not in seen:
            kept.append((k, t, v))
        if t is None:
            seen.add(k)
    return spark.createDataFrame(kept, "k bigint, t bigint, v bigint")


@pytest.mark.parametrize("keys", [["k"], []])
def test_nulls_keep_their_rows_and_places(holes, keys):
    order = ["t"] if keys else ["t", "k"]
    got = number_rows(holes, keys, order, [F.floor(F.col("t") / 10)], "pos", total="n")
    w = Window.partitionBy(*keys)
    want = holes.withColumns({"pos": F.row_number().over(w.orderBy(*order)) - 1, "n": F.count(F.lit(1)).over(w)})
    assert rows(got, "k", "t", "pos", "n") == rows(want, "k", "t", "pos", "n")


def test_running_with_nulls(holes):
    got = running(holes, ["k"], "t", F.floor(F.col("t") / 10), total=("sum", F.col("v")), before=("max_before", F.col("v")), kept=("last", F.col("v")))
    w = Window.partitionBy("k").orderBy("t")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    want = holes.select(
        "k", "t", F.coalesce(F.sum("v").over(upto), F.lit(0)).alias("total"), F.max("v").over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("before"),
        F.last("v", True).over(upto).alias("kept"),
    )
    assert rows(got, "k", "t", "total", "before", "kept") == rows(want, "k", "t", "total", "before", "kept")


def test_a_hundred_thousand_buckets(spark):
    base = spark.range(200_000).select(F.lit(1).alias("k"), (F.col("id") * 3).alias("t"))
    numbered = number_rows(base, ["k"], ["t"], [F.floor(F.col("t") / 6)], "pos", total="n")
    assert numbered.filter("pos <> t / 3 OR n <> 200000").count() == 0 and numbered.count() == 200_000
    # The tables that windows see hold a thousandth of the buckets each.
    named = base.select("k", "t", F.hex("t").alias("name"))
    by_name = number_rows(named, [], ["name"], [F.substring("name", 1, 3)], "pos")
    assert [r.pos for r in by_name.orderBy("name").collect()] == list(range(200_000))


def test_halo_refuses_a_null_index(spark):
    with pytest.raises(Exception, match="dense index"):
        with_halo(spark.sql("SELECT CAST(NULL AS BIGINT) AS i"), "i", 4, before=1).collect()
