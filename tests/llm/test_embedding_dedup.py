"""Vector links against all pairs."""

import numpy as np
import pytest

from gridloom.llm import embedding_dedup as E


def vectors():
    rng = np.random.default_rng(2)
    rows, i = [], 0
    for label in (0, 1, 2):
        for _ in range(60):
            base = rng.normal(size=16)
            for _ in range(rng.choice([1, 1, 3, 12])):
                rows.append((i, (base + rng.normal(size=16) * rng.choice([0, 0.02, 0.12])).astype("f4").tolist(), label))
                i += 1
    return rows


def brute(rows):
    ids = [r[0] for r in rows]
    x = np.array([r[1] for r in rows], dtype=np.float64)
    x /= np.linalg.norm(x, axis=1)[:, None]
    labels = np.array([r[2] for r in rows])
    hit = (x @ x.T >= 0.98) & (labels[:, None] == labels[None, :])
    np.fill_diagonal(hit, False)
    part = np.array(ids)
    while True:
        new = np.minimum(part, np.where(hit, part[None, :], 10**9).min(1))
        if (new == part).all():
            return {i: (int(n), int(c)) for i, n, c in zip(ids, hit.sum(1), part, strict=True)}
        part = new


@pytest.mark.parametrize("block", [256, 4])
def test_links_equal_all_pairs(spark, block):
    rows = vectors()
    odd = [(5000, None, 1), (5001, [0.0] * 16, 1), (5002, [float("nan")] * 16, 1), (5003, [1.0] + [None] * 15, 1), (5004, [], 1), (5005, rows[0][1], None), (5006, [float("inf")] * 16, 1), (5007, [1.0, 0.0], 1), (5008, [2.0, 0.0], 1), (None, rows[0][1], 0)]
    df = spark.createDataFrame([(*r, "x") for r in rows + odd], "vec_id long, embedding array<float>, label int, id string")
    out = E.link(df, block=block).collect()
    got = {r.vec_id: (r.n_links, r.component_id) for r in out}
    expected = brute(rows)
    agree = sum(got[i] == v for i, v in expected.items())
    found, there = sum(got[i][0] for i in expected), sum(v[0] for v in expected.values())
    assert found >= 0.99 * there and found <= there and agree >= 0.98 * len(expected)
    for i in (5000, 5001, 5002, 5003, 5004, 5005, 5006):
        assert got[i] == (0, i)
    assert got[5007] == (1, 5007) and got[5008] == (1, 5007)
    assert got[None] == (0, None) and all(r.kept == (r.vec_id == r.component_id) for r in out if r.vec_id is not None)
    assert E.link(df.where("false")).count() == 0


def test_traversal_visits_nearest_first():
    rng = np.random.default_rng(0)
    a, b = rng.random(6), rng.random(5)
    order = [d for _, _, d in E.traversal(a, b)]
    assert np.allclose(order, np.sort((a[:, None] + b[None, :]).ravel()))


def test_doubles_of_any_size_are_linked(spark):
    rows = [(1, [1e200, 0.0]), (2, [3e300, 0.0]), (3, [1e-200, 0.0]), (4, [5e-324, 0.0]), (5, [0.0, 1e-320]), (6, [0.0, 1e308]), (7, [0.0, 0.0]), (8, [-1.0, 0.0]), (9, [float("-inf"), 0.0])]
    got = {r.vec_id: (r.n_links, r.component_id) for r in E.link(spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {1: (3, 1), 2: (3, 1), 3: (3, 1), 4: (3, 1), 5: (1, 5), 6: (1, 5), 7: (0, 7), 8: (0, 8), 9: (0, 9)}


def test_codewords_grow_with_the_label(spark, monkeypatch):
    """Beyond 256 codewords a half, which once was a limit, links still equal all pairs."""
    tried = []
    monkeypatch.setattr(E, "effort", lambda index, *_: tried.append(len(index.one)) or 1 / len(index.one))  # as many as the size asks for
    rng = np.random.default_rng(9)
    x = rng.normal(size=(2700, 2)) @ rng.normal(size=(2, 12)) + 0.05 * rng.normal(size=(2700, 12))
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    out = E.link(df, per_cell=1 / 36, sample_size=10).collect()
    assert max(tried) > 256
    assert {r.vec_id: (r.n_links, r.component_id) for r in out} == brute(rows)


@pytest.mark.parametrize("size, rank", [(64, 4), (256, 8)])
def test_no_link_is_lost_in_vectors_of_few_dimensions(spark, size, rank):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(4200, rank)) @ rng.normal(size=(rank, size)) + 0.01 * rng.normal(size=(4200, size))
    partner = x[:600] / np.linalg.norm(x[:600], axis=1)[:, None]
    turn = rng.normal(size=(600, rank)) @ np.linalg.svd(x, full_matrices=False)[2][:rank]
    turn -= (turn * partner).sum(1)[:, None] * partner
    x = np.concatenate([x, 0.981 * partner + np.sqrt(1 - 0.981**2) * turn / np.linalg.norm(turn, axis=1)[:, None]])
    rows = [(i, v.astype("f4").tolist(), 0) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in E.link(df, per_cell=1).collect()}
    assert got == brute(rows)


def test_bounds_hold():
    rng = np.random.default_rng(6)
    x = E.unit(rng.normal(size=(800, 3)) @ rng.normal(size=(3, 32)))
    index = E.MultiIndex(x, 64, 0.98)
    visited = index.nearest(x)
    home = [v[0] for v in visited]
    near = np.argwhere(x @ x.T >= 0.98)
    assert len(index.one) == 64 and len(near) > 2000
    for i, j in near.tolist():
        assert (home[j] in visited[i]) + (home[i] in visited[j]) == (2 if home[i] == home[j] else 1)
