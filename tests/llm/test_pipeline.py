"""The stages in their order, each against plain Python on its own input."""

import brute

import corpus_pipeline as cp
from recollect.llm.queries import QUERIES, SQL
from twins import compared, connection

SF = "/root/testdata/sf0.01"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    wanted = {
        "exact dedup": lambda rows: {i for i, x in brute.copies(rows).items() if x[2]},
        "n-gram Jaccard join": lambda rows: {i for i, x in brute.similar(rows).items() if x[0] == i},
        "benchmark decontamination": lambda rows: {i for i, x in brute.contaminated(rows, items).items() if not x[1]},
    }
    for name, stage in cp.STAGES[:-1]:
        path = f"{tmp_path}/{name}".replace(" ", "-")
        stage(spark, docs, SF).write.parquet(path)
        after = spark.read.parquet(path)
        assert after.columns == docs.columns
        if name in wanted:
            assert {r.doc_id for r in after.collect()} == wanted[name]([(r.doc_id, r.text) for r in docs.collect()])
        docs = after
    packed = cp.packed(spark, docs, SF)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == {r.doc_id for r in docs.select("doc_id").collect()}


def test_sql_twins(spark):
    con = connection("/root/testdata/sf0.001")
    for name, sql in SQL.items():
        got, expected = compared(QUERIES[name](spark, "/root/testdata/sf0.001"), con, sql)
        assert got == expected, name


def test_odd_tables(spark, tmp_path):
    """Nulls, empty texts, repeated rows, shared and missing ids, more columns; and no rows at all."""
    import json

    good = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(80)
    rows = good.union(good.filter("doc_id < 5")).union(good.filter("doc_id < 3"))
    odd = spark.createDataFrame([(None, None, None, None, None), (None, "Alone here, with words that nobody else has said.", "en", "x", None), (900, "", "en", "x", 0), (900, None, "en", "x", 0), (901, "x " * 100_000, "en", "x", 200_000)], good.schema)
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    for name, docs in (("odd", rows.union(odd)), ("none", rows.limit(0))):
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        bench.write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
    before = spark.read.parquet(f"{tmp_path}/odd/documents.parquet")
    for _, stage in cp.STAGES[:-1]:
        after = stage(spark, before, f"{tmp_path}/odd")
        assert after.columns == before.columns
        given = {json.dumps([r.doc_id, r.text]) for r in before.collect()}
        assert {json.dumps([r.doc_id, r.text]) for r in after.collect()} <= given
    kept = [(r.doc_id, brute.low(r.text)) for r in cp.without_copies(spark, before, "").collect()]
    every = [(r.doc_id, brute.low(r.text)) for r in before.collect()]
    assert sorted(t for _, t in kept) == sorted({t for _, t in every})
    assert all((i or -1) == max(x if x is not None else -1 for x, u in every if u == t) for i, t in kept if i != 0)
    packed = cp.run(spark, f"{tmp_path}/odd")
    assert packed.columns == cp.run(spark, f"{tmp_path}/none").columns and packed.count() > 0
    assert cp.run(spark, f"{tmp_path}/none").count() == 0
