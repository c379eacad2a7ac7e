"""Rank correlation without a window over a group."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from loomtype.operators.compare import mean_ranks, spearman


def test_ranks_of_ranges_are_the_ranks_of_a_window(spark):
    dice = random.Random(6)
    rows = spark.createDataFrame([("AB"[k % 2], dice.randrange(40), None if k % 31 == 0 else dice.randrange(9)) for k in range(500)], "g string, a int, b int")
    mean = lambda c: F.rank().over(Window.partitionBy("g").orderBy(c)) + (F.count("*").over(Window.partitionBy("g", c)) - 1) / 2
    for c in ("a", "b"):
        ranks = mean_ranks(rows, ["g"], c, 5)
        assert {(r["g"], r[c]): r["rank"] for r in ranks.collect()} == {(r["g"], r[c]): r["m"] for r in rows.withColumn("m", mean(c)).collect()}
    expected = {r["g"]: r["rho"] for r in rows.withColumn("x", mean("a")).withColumn("y", mean("b")).groupBy("g").agg(F.corr("x", "y").alias("rho")).collect()}
    got = spearman(rows, ["g"], "a", "b")
    assert {r["g"]: r["rho"] for r in got.collect()} == pytest.approx(expected)


def test_two_runs_of_one_table_join_their_calls_once(spark):
    from loomtype.plans.queries import queries

    plan = queries()["jn23_compare_two_runs"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "lineitem.parquet" not in plan and "o_custkey" not in plan
