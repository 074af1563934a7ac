import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from atalaya.operators.evaluation import auc_metrics
from atalaya.operators.ordering import (
    approximate_quantiles,
    exact_quantiles,
    global_row_number,
    hash_row_number,
    ordered_bits,
    running_counts,
    value_counts,
)
from atalaya.operators.skew import hot_split_join


@pytest.fixture(scope="module")
def numbers():
    rng = random.Random(7)
    rows = []
    for group in ("a", "b", None):
        for _ in range(500):
            kind = rng.random()
            x = None if kind < 0.05 else rng.choice([0.0, 5.0, -3.5]) if kind < 0.4 else rng.gauss(0, 1) * 10 ** rng.randint(-3, 9)
            rows.append((group, x))
    return rows + [("one", 4.25), ("none", None)]


def test_exact_quantiles_equal_numpy(spark, numbers):
    wanted = {"lo": 0.0, "p1": 0.1, "mid": 0.5, "p99": 0.99, "hi": 1.0}
    found = {r["g"]: r for r in exact_quantiles(spark.createDataFrame(numbers, "g string, x double"), "x", wanted, ["g"]).collect()}
    assert set(found) == {"a", "b", None, "one"}
    for group, row in found.items():
        values = [x for g, x in numbers if g == group and x is not None]
        for name, p in wanted.items():
            assert row[name] == pytest.approx(np.quantile(values, p), rel=1e-12)


def test_exact_quantiles_without_groups_and_with_weights(spark):
    rows = spark.createDataFrame([(1.0, 3), (2.0, 1), (9.0, 4), (None, 5), (float("nan"), 5)], "x double, n bigint")
    copies = [1.0] * 3 + [2.0] + [9.0] * 4
    row = exact_quantiles(rows, "x", {"mid": 0.5, "q": 0.3}, weight="n").first()
    assert (row["mid"], row["q"]) == (np.quantile(copies, 0.5), pytest.approx(np.quantile(copies, 0.3)))
    assert exact_quantiles(rows.where("x > 100"), "x", {"mid": 0.5}).count() == 0
    assert approximate_quantiles(rows.where("x < 5"), "x", {"mid": 0.5}, weight="n").first()["mid"] == 1.0


def test_row_numbers(spark):
    rows = [(i % 3, f"k{i}", float(i % 7)) for i in range(400)]
    df = spark.createDataFrame(rows, "g int, k string, s double").repartition(5)
    numbered = global_row_number(df, [F.desc("s"), F.asc("k")], "r").collect()
    expected = sorted(rows, key=lambda r: (-r[2], r[1]))
    assert [r["k"] for r in sorted(numbered, key=lambda r: r["r"])] == [r[1] for r in expected]
    assert sorted(r["r"] for r in numbered) == list(range(1, 401))

    hashed = hash_row_number(df.withColumn("h", F.md5("k")), ["g"], "h", ["k"], "r").collect()
    for g in range(3):
        part = sorted((r for r in hashed if r["g"] == g), key=lambda r: r["r"])
        assert [r["r"] for r in part] == list(range(len(part)))
        assert [r["h"] for r in part] == sorted(r["h"] for r in part)


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("rows_per_split", [3, 10_000])
def test_hot_split_join_loses_and_repeats_nothing(spark, how, rows_per_split):
    facts = spark.createDataFrame([("hot" if i % 2 else None if i % 8 == 0 else f"k{i}", i) for i in range(200)], "k string, i int")
    counts = facts.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    lookup = counts.where("k is null or k <> 'k2'").select("k", (F.col("n") * 10).alias("v"))
    found = hot_split_join(facts, lookup, ["k"], counts, "n", how, rows_per_split=rows_per_split)
    known = {r["k"]: r["v"] for r in lookup.collect()}
    expected = [(r["k"], r["i"], known.get(r["k"])) for r in facts.collect() if how == "left" or r["k"] in known]
    assert sorted(map(str, [tuple(r) for r in found.select("k", "i", "v").collect()])) == sorted(map(str, expected))


def test_areas_equal_brute_force(spark):
    rng = random.Random(3)
    rows = [(int(rng.random() < 0.3), rng.choice([0.1, 0.2, 0.2, 0.5, round(rng.random(), 2)])) for _ in range(300)]
    found = auc_metrics(spark.createDataFrame(rows, "label int, score double")).first()
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    wins = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
    assert found["auc_roc"] == pytest.approx(wins / len(pos) / len(neg))
    area, last = 0.0, None
    for s in sorted({s for _, s in rows}, reverse=True):
        tp, fp = sum(p >= s for p in pos), sum(n >= s for n in neg)
        point = (tp / len(pos), tp / (tp + fp))
        previous = last or (0.0, point[1])
        area += (point[0] - previous[0]) * (point[1] + previous[1]) / 2
        last = point
    assert found["auc_pr"] == pytest.approx(area)


def test_bits_are_in_the_order_of_the_values(spark):
    values = sorted([float("-inf"), -1e300, -2.0, -1.0, -5e-324, 0.0, 5e-324, 2.2250738585072014e-308, 1.0, float(np.nextafter(1.0, 2)), 1e9, float("inf")])
    rows = spark.createDataFrame([(v,) for v in [*values, -0.0]], "x double").select("x", ordered_bits(F.col("x")).alias("bits"))
    found = {}
    for row in rows.collect():
        assert found.setdefault(row["x"], row["bits"]) == row["bits"]
    assert [found[v] for v in values] == sorted(found.values()) and len(set(found.values())) == len(values)


def test_dense_values_are_not_ordered_by_one_task(spark):
    """A hundred thousand distinct values within a thousandth of each other."""
    rows = spark.range(100_000).select((F.lit(1000.0) + F.col("id") * F.lit(1e-6)).alias("x"))
    row = exact_quantiles(rows, "x", {"mid": 0.5, "p99": 0.99}).first()
    values = 1000.0 + np.arange(100_000) * 1e-6
    assert row["mid"] == pytest.approx(np.quantile(values, 0.5), rel=1e-15) and row["p99"] == pytest.approx(np.quantile(values, 0.99), rel=1e-15)
    together = value_counts(rows, "x").groupBy("_part1").count()
    assert together.count() > 100 and together.agg(F.max("count")).first()[0] < 2000


def test_running_counts_follow_wanted_ranks_only(spark):
    rows = spark.createDataFrame([(i % 2, float(i % 50), 1) for i in range(400)], "g int, x double, n long")
    counted = value_counts(rows, "x", ["g"], {"n": F.sum("n")})
    every = {(r["g"], r["value"]): (r["n_before"], r["n_total"]) for r in running_counts(counted, ["g"]).collect()}
    assert every == {(g, float(x)): (8 * (x // 2), 200) for g in (0, 1) for x in range(g, 50, 2)}
    one = running_counts(counted, ["g"], wanted=lambda first, last, total: (first <= 100) & (last >= 100)).collect()
    assert [(r["g"], r["n_before"]) for r in sorted(one, key=lambda r: r["g"])] == [(0, 96), (1, 96)]
