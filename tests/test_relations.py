"""Relations seen from either end, verdicts that leave other rows alone."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from recollect.operators import relations as rl

OLD = datetime(2026, 1, 1)


def at(day: datetime = datetime(2026, 3, 2)):
    return F.lit(day).cast("timestamp_ntz")


@pytest.fixture()
def tables(spark):
    o = spark.createDataFrame([(1, "a", "A", "p", None), (2, "b", "B", "q", None), (3, "c", "C", "p", None), (4, "d", "D", "p", OLD)], "id long, sync_id string, title string, project string, deleted_at timestamp_ntz")
    rel = [
        (1, "r1", "a", "c", "related", "old", 0.5, "judged", "e1", "x", "agent", "m", "s1", OLD, OLD, None),
        (2, "r2", "b", "a", "pending", None, None, "pending", None, None, None, None, None, OLD, OLD, None),
        (3, "r3", "c", "a", "scoped", "gone", 0.9, "judged", "e3", "y", "agent", "m", "s3", OLD, OLD, OLD),
        (4, "r4", "c", "zz", "pending", None, None, "pending", None, None, None, None, None, OLD, OLD, None),
        (5, "r5", "c", "d", "compatible", None, 0.1, "judged", None, "z", "system", "m", None, OLD, OLD, None),
    ]
    schema = "id long, sync_id string, source_id string, target_id string, relation string, reason string, confidence double, judgment_status string, evidence string, marked_by_actor string, marked_by_kind string, marked_by_model string, session_id string, created_at timestamp_ntz, updated_at timestamp_ntz, deleted_at timestamp_ntz"
    return spark.createDataFrame(rel, schema), o


def test_a_project_has_the_relations_of_either_end(tables):
    r, o = tables
    ids = lambda df: sorted(x.id for x in df.collect())
    assert ids(rl.listed(r, o, "q")) == [2] and ids(rl.listed(r, o, "p")) == [1, 2, 4, 5] and ids(rl.listed(r, o)) == [1, 2, 4, 5]
    assert ids(rl.listed(r, o, "p", "pending")) == [2, 4]
    assert rl.stats(r, o, "p").first() == (4, 2, 2, 0) and rl.stats(r, o, "q").first() == (1, 1, 0, 0) and rl.stats(r, o, "none").first() == (0, 0, 0, 0)
    assert sorted(map(tuple, rl.verb_counts(r, o, "p").collect())) == [("compatible", 1), ("related", 1)]


def test_verdicts_leave_other_rows_alone(spark, tables):
    r, o = tables
    said = spark.createDataFrame([(2, "related", 1), (4, "scoped", 1), (4, "bad", 2), (4, "compatible", 3), (3, "related", 1), (5, "nonsense", 1)], "id long, verb string, n int")
    said = said.withColumns({"why": F.lit("w"), "sure": F.lit(0.7), "actor": F.lit("me"), "kind": F.lit("agent"), "model": F.lit("m2"), "evidence": F.lit("here"), "session": F.lit("s9")})
    got = {x.id: x for x in rl.judged(r, o, said, at()).collect()}
    before = {x.id: x for x in r.collect()}
    assert len(got) == 5
    for i in (1, 2, 3, 5):
        assert all(got[i][c] == before[i][c] for c in r.columns), i
    assert {i: x.error for i, x in got.items()} == {1: "", 2: "project", 3: "deleted", 4: "", 5: "verb"}
    x = got[4]
    assert (x.relation, x.reason, x.evidence, x.confidence, x.judgment_status, x.marked_by_actor, x.marked_by_kind, x.marked_by_model, x.session_id, x.updated_at) == ("compatible", "w", "here", 0.7, "judged", "me", "agent", "m2", "s9", datetime(2026, 3, 2))
    assert x.created_at == OLD


def test_tables_without_marks_get_them(spark, tables):
    r, o = tables
    bare = r.select("id", "sync_id", "source_id", "target_id", "relation", "reason", "confidence", "judgment_status", "created_at")
    got = {x.id: x for x in rl.judged(bare, o, spark.createDataFrame([(1, "scoped")], "id long, verb string"), at()).collect()}
    assert got[1].relation == "scoped" and got[1].evidence is None and got[2].relation == "pending"


def test_meaning_finds_relations_of_either_direction(spark, tables):
    r, o = tables
    said = spark.createDataFrame([("c", "a", "conflicts_with", 0.8, "w", "m2", 1), ("a", "c", "supersedes", 0.9, "v", "m2", 2), ("b", "c", "related", 0.6, "u", "m2", 1), ("b", "d", "odd", 0.6, "u", "m2", 1)], "source_id string, target_id string, verb string, sure double, why string, model string, n int")
    once = rl.judge_by_meaning(r, said, at())
    got = {x.sync_id: x for x in once.collect()}
    assert len(got) == 6
    assert (got["r1"].relation, got["r1"].source_id, got["r1"].marked_by_actor, got["r1"].evidence, got["r1"].session_id) == ("supersedes", "a", "engine", "e1", "s1")
    before = {x.sync_id: x for x in r.collect()}
    assert all(got[s] == before[s] for s in ("r2", "r3", "r4", "r5"))
    (new,) = [x for s, x in got.items() if s not in before]
    assert new.id is not None and (new.source_id, new.target_id, new.relation, new.judgment_status) == ("b", "c", "related", "judged")
    again = {x.sync_id for x in rl.judge_by_meaning(once, said, at()).collect()}
    assert again == set(got)  # the same call again adds no row


def test_collection(tables):
    r, o = tables
    gone = {x.id: x.deleted_at for x in rl.collected(r, o, at(datetime(2026, 1, 20))).collect()}
    assert gone == {1: None, 2: None, 3: OLD, 4: datetime(2026, 1, 20), 5: datetime(2026, 1, 20)}
    assert {x.id for x in rl.collected(r, o, at()).filter("deleted_at IS NOT NULL").collect()} == {2, 3, 4, 5}


def test_sources_without_strong_documents_in_their_scope_keep_few_pairs(spark, monkeypatch):
    """The strongest documents of the words are foreign, so nothing is known of the best; still only what may be among them is written."""
    from recollect.operators import matching as mt

    written, keep = {}, mt.spool
    monkeypatch.setattr(mt, "spool", lambda df, name: written.setdefault(name, keep(df, name)))
    rows = [(i, f"s{i}", "p" if i < 300 else "q", "project", None, ["a", "b"] + ["x"] * (30 if i < 300 else 1)) for i in range(600)]
    o = spark.createDataFrame(rows, "id long, sync_id string, project string, scope string, deleted_at string, toks array<string>")
    none = spark.createDataFrame([("s0", "s1", None)], "source_id string, target_id string, deleted_at string")
    asked = o.filter("id IN (0, 7)").select("id", "sync_id", "project", F.slice("toks", 1, 2).alias("terms"))
    got = sorted((r.src, r.rk, r.id) for r in rl.candidates(o, asked, none, limit=3, floor=None).collect())
    assert got == [(0, 1, 2), (0, 2, 3), (0, 3, 4), (7, 1, 0), (7, 2, 1), (7, 3, 2)]
    assert written["survivors"].count() <= 2 * 9 * 8  # of 598; nine for each of eight parts at most
