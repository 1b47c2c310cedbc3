"""Rank correlation by inversions against all pairs, with ties, copies, nulls and a group over many slices."""

import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from faultline.operators.concordance import concordance, inversions


def plain(pairs):
    def sign(a, b):
        return (a > b) - (a < b)

    signs = [sign(p[0], q[0]) * sign(p[1], q[1]) for p, q in combinations(pairs, 2)]
    return len(pairs), len(signs), signs.count(-1), sum(signs) / len(signs) if signs else None


def test_inversions_of_segments():
    rng = np.random.default_rng(4)
    lengths = [1, 2, 7, 1, 64, 33]
    starts = np.cumsum([0, *lengths[:-1]])
    rank, weight = rng.permutation(sum(lengths)), rng.integers(1, 5, sum(lengths))
    want = [sum(int(weight[i] * weight[j]) for i, j in combinations(range(s, s + n), 2) if rank[i] > rank[j]) for s, n in zip(starts, lengths)]
    assert inversions(starts, rank, weight).tolist() == want


@pytest.mark.parametrize("rows", [40, 100_000])
def test_tau_equals_all_pairs(spark, rows):
    rng = random.Random(8)
    groups = {
        "large": [(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(700)],
        "copies": [(rng.randint(0, 2), rng.randint(0, 2)) for _ in range(90)],
        "tied": [(5, i) for i in range(60)],
        "reverse": [(i, -i) for i in range(150)],
        None: [(i, i * i) for i in range(50)],
        "one": [(1, 1)],
    }
    data = [(k, a, b) for k, pairs in groups.items() for a, b in pairs] + [("one", None, 3), ("one", 3, None), ("gone", None, None)]
    rng.shuffle(data)
    df = spark.createDataFrame(data, "k string, _w int, b int").repartition(4)
    got = {r["k"]: tuple(r)[1:] for r in concordance(df, ["k"], F.col("_w"), F.col("b"), rows).collect()}
    want = {k: plain(pairs) for k, pairs in groups.items()}
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == pytest.approx(want[k], abs=1e-12)


def test_no_rows(spark):
    empty = spark.createDataFrame([], "k string, a int, b int")
    assert concordance(empty, ["k"], F.col("a"), F.col("b")).collect() == []


def test_a_million_ranks_in_one_case(spark):
    n, m = 1_000_000, 7
    df = spark.range(n).selectExpr("1 as k", "id as a", f"id * {m} % {n} as b")
    r = concordance(df, ["k"], F.col("a"), F.col("b")).first()
    values = np.arange(n) * m % n
    want = int(inversions(np.array([0]), values, np.ones(n, np.int64))[0])
    assert (r["n"], r["pairs"], r["discordant"]) == (n, n * (n - 1) // 2, want)
