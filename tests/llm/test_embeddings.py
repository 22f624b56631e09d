"""Lattice hashing against all pairs."""

import math

import numpy as np
import pytest

from recollect.llm import embedding_dedup as ed

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, least=0.9):
    """(n_links, component_id, kept) of each row by all pairs, by position."""
    vectors = []
    for _, v in rows:
        ok = v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v)
        vectors.append(np.array(v, np.float32).astype(float) if ok else None)
    n, root = len(rows), list(range(len(rows)))
    links = [0] * n

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i + 1, n):
            a, b = vectors[i], vectors[j]
            if a is None or b is None or len(a) != len(b):
                continue
            if a @ b / math.sqrt((a @ a) * (b @ b)) >= least:
                links[i] += 1
                links[j] += 1
                root[top(j)] = top(i)
    ids = {}
    for i, (x, _) in enumerate(rows):
        ids.setdefault(top(i), []).append(x)
    out = []
    for i, (x, _) in enumerate(rows):
        least_id = min((y for y in ids[top(i)] if y is not None), default=None)
        out.append((x, links[i], least_id, x == least_id))
    return sorted(out, key=str)


def found(spark, rows, **more):
    frame = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).repartition(3)
    return sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in ed.lattice_join(frame, **more).collect()), key=str)


def clusters(seed=1, dim=24, centres=20, each=15):
    rng = np.random.default_rng(seed)
    rows = []
    for c in rng.normal(size=(centres, dim)):
        c = c / np.linalg.norm(c)
        for _ in range(each):
            noise = rng.normal(size=dim) / math.sqrt(dim)
            rows.append((len(rows), [float(np.float32(x)) for x in c + rng.choice([0.05, 0.3, 0.45]) * noise]))
    return rows


def test_lattice_points_are_the_nearest():
    x = np.random.default_rng(0).normal(size=(300, 8)) * 2
    home = ed.lattice_point(x)
    assert len(ed.ROOTS) == 240 and np.allclose((ed.ROOTS**2).sum(1), 2)
    whole = np.all(home == np.rint(home), axis=1) | np.all(home * 2 % 2 == 1, axis=1)
    assert whole.all() and np.all(home.sum(1) % 2 == 0)
    for step in ed.ROOTS:
        assert np.all(((x - home) ** 2).sum(1) <= ((x - home - step) ** 2).sum(1) + 1e-12)
    near = ed.cells(x, 4)
    distance = ((x[:, None] - near) ** 2).sum(2)
    others = np.sort(((x[:, None] - home[:, None] - ed.ROOTS) ** 2).sum(2), axis=1)[:, :4]
    assert np.allclose(np.sort(distance[:, 1:], axis=1), others)


def test_signatures_do_not_depend_on_the_batch():
    v = np.array([r[1] for r in clusters()])
    whole = ed.signature(v, 3, 2)
    assert np.array_equal(whole, np.concatenate([ed.signature(v[i : i + 7], 3, 2) for i in range(0, len(v), 7)]))


@pytest.mark.parametrize("points", [1, 2])
def test_links_equal_all_pairs(spark, points):
    rows = clusters()
    assert found(spark, rows, recall=0.99999, points=points) == brute(rows)


def test_recall_at_the_threshold(spark):
    """Pairs just above the threshold, the hardest: found with the promised probability."""
    rng = np.random.default_rng(4)
    rows = []
    for _ in range(400):
        a, b = rng.normal(size=(2, 32))
        a /= np.linalg.norm(a)
        b -= a * (a @ b)
        b /= np.linalg.norm(b)
        c = 0.9005
        rows += [(len(rows), a.tolist()), (len(rows) + 1, (c * a + math.sqrt(1 - c * c) * b).tolist())]
    got = found(spark, rows)
    assert sum(r[1] for r in got) >= 0.98 * 800


def test_a_large_group_of_near_copies_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(ed, "BLOCK", 16)
    rng = np.random.default_rng(2)
    centre = rng.normal(size=16)
    rows = [(i, (centre + 0.02 * rng.normal(size=16)).tolist()) for i in range(150)]
    assert found(spark, rows) == [(i, 149, 0, i == 0) for i in sorted(range(150), key=str)] or found(spark, rows) == brute(rows)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (5, [1.0, 0.0]), (3, [2.0, 0.0]), (3, [0.0, 1.0]), (4, [0.0, 1.0]), (4, [0.0, 1.0]), (None, [0.0, 3.0]), (None, None), (9, None), (10, [0.0, 0.0]), (11, [nan, 1.0]), (12, [inf, 1.0]),
        (13, [None, 1.0]), (14, []), (15, [1.0, 0.0, 0.0]), (16, [-1.0, 0.0]), (17, [1e-30, 0.0]), (18, [3e38, 0.0]), (None, [-5.0, -5.0]),
    ]
    assert found(spark, rows, recall=0.99999) == brute(rows)


def test_empty_table(spark):
    assert found(spark, []) == []


def test_clashing_columns(spark):
    frame = spark.createDataFrame([("a", [1.0, 2.0], "k", 3), ("b", [1.0, 2.0], "k", 4)], "name string, emb array<double>, key string, n int")
    got = sorted(tuple(r) for r in ed.lattice_join(frame, id_col="name", vector_col="emb").collect())
    assert got == [("a", 1, "a", True), ("b", 1, "a", False)]
