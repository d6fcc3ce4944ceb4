"""Pairs by lists of neighbours: large keys, and members of many ages."""

import itertools

import numpy as np
from pyspark.sql import functions as F

from eonmap.operators import graph, numbering, relational


def pairs_of(lists):
    return sorted((r["k"], a, b) for r in lists.collect() for a, b in ((r["a"], b) for b in r["bs"]))


def test_lists_hold_each_pair_once(spark):
    rows = spark.createDataFrame([(k, n) for k, m in ((1, 25), (2, 1), (3, 7)) for n in range(m)] * 2, "k int, n int")
    for block in (1000, 4):
        lists = numbering.key_neighbours(rows, ["k"], "n", block)
        assert pairs_of(lists) == sorted((k, a, b) for k, m in ((1, 25), (3, 7)) for a, b in itertools.combinations(range(m), 2))
        assert lists.agg(F.max(F.size("bs"))).first()[0] <= (24 if block == 1000 else 20)


def test_edges_move_lists_not_pairs(spark):
    rows = spark.createDataFrame([(k, n) for k in range(5) for n in range(20)], "k int, n int")
    plan = relational.shared_key_edges(rows, "k", "n", 2)._jdf.queryExecution().executedPlan().toString()
    assert "bs#" in plan and "explode" in plan.split("REPARTITION_BY_NUM")[0]  # pairs are made after the last exchange
    assert relational.shared_key_edges(rows, "k", "n", 2).where("shared = 5").count() == 190


def test_only_contemporaries_are_listed(spark):
    rng = np.random.default_rng(5)
    rows = [(int(rng.integers(0, 3)), int(rng.integers(0, 30)), s := int(rng.integers(0, 500)), s + int(rng.integers(-3, 25))) for _ in range(200)]
    rows += [(0, 40, 0, 10**9), (1, 41, 7, 7), (1, 42, None, 5)]
    want = sorted({(k, *sorted((a, b))) for (k, a, s, e), (l, b, t, u) in itertools.permutations(rows, 2) if k == l and a != b and None not in (s, t) and s < u and t < e})
    table = spark.createDataFrame(rows, "k int, n int, s int, e int")
    for block in (1000, 3):
        found = pairs_of(numbering.overlapping_neighbours(table, "k", "n", "s", "e", block))
        assert sorted({(k, *sorted((a, b))) for k, a, b in found}) == want
    apart = spark.createDataFrame([(1, n, 10 * n, 10 * n + 5) for n in range(300)], "k int, n int, s int, e int")
    assert numbering.overlapping_neighbours(apart, "k", "n", "s", "e").isEmpty()
    none = apart.where("n < 0")
    assert numbering.overlapping_neighbours(none, "k", "n", "s", "e").isEmpty()


def test_both_ways_to_edges_agree(spark):
    rng = np.random.default_rng(6)
    ways = spark.createDataFrame([(int(rng.integers(0, 40)), int(rng.integers(0, 12))) for _ in range(150)], "node int, way_id int")
    ranges = spark.createDataFrame([(n, s := int(rng.integers(0, 60)), s + int(rng.integers(0, 20))) for n in range(40) for _ in range(2)], "node int, start int, end int")
    edges = [sorted(map(tuple, graph.node_edges(ways, ranges, of_ages).collect())) for of_ages in (False, True)]
    assert edges[0] == edges[1] and len(edges[0]) > 50
