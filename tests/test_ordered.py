"""Chunked execution of ordered work gives what one task per group gives."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from surveyspark.operators import ordered as od

# one key holds most rows
DATA = [("hot", i) for i in range(400)] + [("cold", i) for i in range(7)] + [(None, i) for i in range(3)]


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(7)
    rows = [(k, i, rng.choice([None, *range(20)])) for k, i in DATA]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "k string, i bigint, v bigint").repartition(6)


def both(table, build, position=None):
    plain = od.arrange(table, ["k"], ["i"])
    cut = od.arrange(table, ["k"], ["i"], group_rows=37, position=position)
    assert plain.chunk is None and cut.chunk is not None
    results = []
    for arranged in (plain, cut):
        out = build(arranged).done()
        results.append(sorted(map(str, out.select(sorted(out.columns)).collect())))
    assert results[0] == results[1] and len(results[0]) == len(DATA)


@pytest.mark.parametrize("position", [None, "i"])
def test_lag(table, position):
    both(table, lambda a: a.lag(p=F.col("v"), q=F.col("i")), position)


@pytest.mark.parametrize("position", [None, "i"])
def test_running_sum_and_totals(table, position):
    both(table, lambda a: a.running_sum(s=F.col("v"), n=F.lit(1), totals=True), position)


def test_index_counts_from_zero(table):
    both(table, lambda a: a.index("at"))
    out = od.arrange(table, ["k"], ["i"], group_rows=37).index("at").done()
    assert out.where("at <> i").isEmpty()


def test_rolling_frames_cross_cuts(table):
    def frames(w):
        return {"m": F.max("v").over(w), "c": F.count("v").over(w), "md": F.percentile("v", F.lit(0.5)).over(w)}

    both(table, lambda a: a.rolling(5, 5, frames))


def test_chunks_are_bounded(table):
    cut = od.arrange(table, ["k"], ["i"], group_rows=37)
    largest = cut.df.groupBy("k", cut.chunk).count().agg(F.max("count")).first()[0]
    assert largest <= 3 * 37


@pytest.mark.parametrize("limit", [None, 5])
def test_quantiles_are_exact(spark, limit):
    rng = np.random.default_rng(3)
    values = {"a": rng.normal(size=101), "b": np.repeat([1.0, 5.0], [90, 3]), "c": np.array([4.0])}
    df = spark.createDataFrame(
        [(k, float(v)) for k, vs in values.items() for v in vs] + [("a", None)], "k string, v double"
    )
    out = od.quantiles(df, ["k"], F.col("v"), {"half": 0.5, "high": 0.95}, group_rows=limit).collect()
    for r in out:
        assert r["half"] == pytest.approx(np.quantile(values[r["k"]], 0.5))
        assert r["high"] == pytest.approx(np.quantile(values[r["k"]], 0.95))
    both_ways = [
        {
            r["k"]: (r["n"], r["m"])
            for r in od.aggregate_with_quantiles(
                df, ["k"], [F.count("*").alias("n")], {"m": (F.col("v"), 0.5)}, group_rows=g
            ).collect()
        }
        for g in (None, 5)
    ]
    assert both_ways[0] == both_ways[1]
