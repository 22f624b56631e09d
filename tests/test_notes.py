"""Write resolution, search syntax, vectors and text functions on known cases."""

import pytest
from pyspark.sql import functions as F

from recollect.functions import text as tx
from recollect.operators import observations as ob
from recollect.operators import search as se
from recollect.operators import vectors as ve


def saves(spark, *rows):
    return spark.createDataFrame([(i, "save", p, t, h, title) for i, (p, t, h, title) in enumerate(rows)], "id long, op string, project string, topic_key string, normalized_hash string, title string")


def test_topic_upsert_and_hash_dedup(spark):
    got = ob.fold_saves(saves(spark, ("p", "k", "1", "v1"), ("p", "k", "2", "v2"), ("q", "k", "1", "other"), ("p", "", "9", "same"), ("p", "", "9", "same"))).collect()
    rows = {(r.project, r.title): (r.revision_count, r.duplicate_count) for r in got}
    assert len(got) == 3 and rows[("p", "v2")][0] == 2 and rows[("p", "same")][1] == 2


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_project_name(spark):
    assert one(spark, tx.project_name(F.lit("ATISA Provider-Management"))) == "atisa-provider-management"


def test_repo_name(spark):
    assert one(spark, tx.repo_name(F.lit("git@host:team/tool.git"))) == "tool"


@pytest.mark.parametrize("text, n", [("## Key Learnings:\n\n1. the cache must be warm before use\n2. tests need a clock that is fixed", 2), ("no header\n- nothing here to be taken", 0)])
def test_learnings(spark, text, n):
    assert len(one(spark, tx.learnings(F.lit(text))) or []) == n


def test_redaction_hides_the_value(spark):
    secret = "AKIA" + "ABCDEFGHIJKLMNOP"
    assert secret not in one(spark, tx.redact(F.lit(f"key {secret} end")))


def test_search_needs_all_words_and_knows_or_not_and_phrases(spark):
    rows = [(1, "alpha beta"), (2, "beta gamma"), (3, "alpha gamma beta")]
    toks = spark.createDataFrame(rows, "id long, content string").withColumn("toks", se.tokens("content"))
    find = lambda q: sorted(r.id for r in toks.filter(se.condition(se.parse(q))).collect())
    assert find('"alpha" "beta"') == [1, 3]
    assert find('"alpha" OR "gamma"') == [1, 2, 3]
    assert find('"beta" NOT "gamma"') == [1]
    assert find('"alpha beta"') == [1]
    assert find("gam*") == [2, 3]


def test_cosine(spark):
    v = lambda *x: F.array(*(F.lit(float(y)) for y in x))
    assert one(spark, ve.cosine(v(1, 0), v(1, 0))) == 1 and one(spark, ve.cosine(v(1, 0), v(0, 1))) == 0
    assert one(spark, ve.cosine(v(0, 0), v(0, 1))) is None


def test_project_names_are_made_once(spark):
    names = {"": "unknown", " \t\n": "unknown", "--": "unknown", " My Repo\n": "my-repo", "\x0b-a_b--C-- ": "a_b--c", "Ñandú/x\ny": "and--x-y", "𝒳a": "a", "a𝒳b": "a-b", None: None}
    rows = spark.createDataFrame(list(enumerate(names)), "id long, x string").select("x", tx.project_name(F.col("x")).alias("name"))
    assert {r.x: r.name for r in rows.collect()} == names
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("[^a-z0-9_-]") == 1
