"""Nearest neighbours of any number of queries, against plain Python."""

import numpy as np
import pytest

from recollect.operators import vectors as ve
from recollect.plans.registry import QUERIES


@pytest.mark.parametrize("n, n_queries, most", [(1300, 1100, 1000), (60, 40, 7), (60, 40, 40)])
def test_more_queries_than_a_task_holds(spark, n, n_queries, most):
    x = np.random.default_rng(4).normal(size=(n, 3))
    v = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "id long, embedding array<double>")
    got = {(r.query_id, r.rk): (r.id, r.sim) for r in ve.knn(v, v.filter(f"id < {n_queries}"), 3, 0.2, most).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    wanted = {}
    for q, sims in enumerate((unit[:n_queries] @ unit.T).round(6)):
        near = sorted((-s, i) for i, s in enumerate(sims) if i != q and s >= 0.2)[:3]
        wanted.update({(q, rk): (i, -s) for rk, (s, i) in enumerate(near, 1)})
    assert got.keys() == wanted.keys()
    assert all(got[k][1] == pytest.approx(wanted[k][1], abs=2e-6) for k in wanted)
    assert np.mean([got[k][0] == wanted[k][0] for k in wanted]) > 0.99  # the last digit of a similarity may turn a tie


def test_related_keeps_all_neighbours(spark, tmp_path):
    rows = [(100 + i, [1.0, 0.01 * i]) for i in range(6)] + [(200, [0.0, 1.0])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert {(r.query_id, r.id) for r in QUERIES["related_085"](spark, str(tmp_path)).collect()} == {(100, 100 + i) for i in range(1, 6)}


def test_blocks_that_bounds_rule_out_are_not_compared(spark):
    """Clustered vectors: the neighbours of all pairs, from a small share of them."""
    import numpy as np

    from recollect.operators import neighbours

    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 12))
    rows = [(i, [float(x) for x in centres[i % 40] + 0.1 * rng.normal(size=12)]) for i in range(800)]
    rows += [(900, [0.0] * 12), (901, None), (902, [1.0, 2.0]), (903, rows[5][1]), (904, rows[5][1])]
    v = spark.createDataFrame(rows, "id long, embedding array<double>").repartition(3)
    q = v.filter("id % 100 = 0 OR id IN (5, 903)")
    got, pairs = neighbours.nearest(v, q, 7, 0.3, n=60)
    sound = v.filter("size(embedding) = 12")
    wanted = ve.knn(sound, sound.filter("id % 100 = 0 OR id IN (5, 903)"), 7, 0.3)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, wanted.collect()))
    share = sum(r.size for r in pairs.collect()) / (803 * 10)
    assert share < 0.35, share


def test_only_what_may_be_nearest_leaves_a_block(spark):
    """Odd vectors have the cosines of the plain expression; of 4,000 in blocks few pairs are left to be ranked."""
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in rng.normal(size=5)]) for i in range(4000)]
    rows += [(5000, [0.0] * 5), (5001, None), (5002, [1.0, 2.0]), (5003, [1.0, None, 0.0, 0.0, 0.0]), (5004, rows[0][1]), (5005, []), (5006, [2.0, 4.0])]
    v = spark.createDataFrame(rows, "id long, embedding array<double>")
    q = v.filter("id % 500 = 0 OR id > 5000")
    x, y = v.selectExpr("id", "embedding AS a"), q.selectExpr("id AS query_id", "embedding AS b")
    plain = x.crossJoin(y).filter("id <> query_id").select("query_id", "id", ve.F.round(ve.cosine(ve.F.col("a"), ve.F.col("b")), 6).alias("sim")).filter("sim >= 0.9")
    assert sorted(map(tuple, ve.similar(v, q, 0.9, 4).collect())) == sorted(map(tuple, plain.collect())) != []
    assert ve.similar(v, q, -1.0, 4, k=3).count() < 0.05 * 4000 * 10


def of_notes(spark, *vectors):
    """Vectors, and their notes: every third is deleted."""
    v = spark.createDataFrame([(i, [float(x) for x in e]) for i, e in enumerate(vectors)], "id long, embedding array<double>")
    return v, v.select("id", ve.F.when(ve.F.col("id") % 3 == 2, "2024-01-01").alias("deleted_at"))


def test_neighbours_among_rows_of_one_table_that_notes_let_through(spark):
    v, notes = of_notes(spark, (1, 0), (1, 0.1), (1, 0.01), (1, 0.2), (0, 1))
    near = ve.knn(ve.seen(v, notes, ve.F.col("deleted_at").isNull()), v.filter("id IN (0, 2)"), 2, 0.2)
    assert sorted((r.query_id, r.rk, r.id) for r in near.collect()) == [(0, 1, 1), (0, 2, 3), (2, 1, 0), (2, 2, 1)]
    lexical = v.select("id", (ve.F.col("id") - 5.0).alias("rank"))
    assert [r.id for r in ve.hybrid(lexical, near.filter("query_id = 0"), 3).collect()] == [1, 3, 0]


def context(spark, least):
    v, notes = of_notes(spark, (1, 0), (1, 0.1), (1, 0.01), (1, 0.2), (0, 1))
    near = ve.knn(ve.seen(v, notes, ve.F.col("deleted_at").isNull()), v.filter("id = 4"), 2, least)
    got = ve.prompt_context(near, v.filter("id IN (0, 1)").select("id"), v.filter("id = 1").select("id"))
    return sorted(map(tuple, got.collect()))


def test_context_of_a_prompt_falls_back_to_texts(spark):
    assert context(spark, 0.65) == [(0, "text")]


def test_context_of_a_prompt_has_vectors_that_were_not_shown(spark):
    assert context(spark, 0.05) == [(3, "vector")]
