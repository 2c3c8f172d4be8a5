"""Connected components against union-find."""

import random

import pytest

from gridloom.llm import common


def brute(edges):
    root = {}

    def find(a):
        while root.setdefault(a, a) != a:
            a = root[a]
        return a

    for a, b in edges:
        if a is not None and b is not None:
            lo, hi = sorted((find(a), find(b)))
            root[hi] = lo
    return {a: find(a) for a in root}


def shapes():
    rng = random.Random(3)
    ids = rng.sample(range(10**6), 1000)
    yield "shuffled chain", list(zip(ids, ids[1:]))
    yield "ordered chain", [(i, i + 1) for i in range(1000)]
    mixed = [(rng.randrange(900), rng.randrange(900)) for _ in range(500)] + [(5000, i) for i in range(5001, 5400)] + [(7, 7), (-3, -3), (-3, -9), (None, 1), (2, None), (8000, 8000)]
    yield "mixed", mixed
    yield "chain of stars", [(i, i + 1) for i in range(60)] + [(i, 1000 + i * 100 + k) for i in range(60) for k in range(i)]


@pytest.mark.parametrize("edges", [pytest.param(e, id=n) for n, e in shapes()])
def test_components_equal_union_find(spark, monkeypatch, edges):
    rounds = []
    kept = common.stage
    monkeypatch.setattr(common, "stage", lambda df, name: rounds.append(name) or kept(df, name))
    rows = common.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()
    assert {r.node: r.component for r in rows} == brute(edges) and len(rows) == len(brute(edges))
    assert rounds.count("labels") == 1 and rounds.count("moves") <= 20


def test_star_goes_in_a_round(spark, monkeypatch):
    rounds = []
    kept = common.stage
    monkeypatch.setattr(common, "stage", lambda df, name: rounds.append(name) or kept(df, name))
    rows = common.connected_components(spark.createDataFrame([(500, i) for i in range(400)], "src long, dst long")).collect()
    assert {r.component for r in rows} == {0} and len(rows) == 401 and rounds.count("moves") == 1


@pytest.mark.parametrize("share", [0.0, 0.3, 0.9, 1.0])
def test_further_edges_equal_union_find(spark, share):
    rng = random.Random(5)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(330)]
    cut = int(share * len(edges))
    make = lambda e: spark.createDataFrame(e, "src long, dst long")
    rows = common.joined_components(common.connected_components(make(edges[:cut])), make(edges[cut:])).collect()
    assert {r.node: r.component for r in rows} == brute(edges) and len(rows) == len(brute(edges))


def test_no_edges(spark):
    assert common.connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0
