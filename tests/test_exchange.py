"""Two stores that exchange chunks, and files that follow a store."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from recollect.operators import saves
from recollect.plans.registry import QUERIES
from recollect.sources import mirror
from recollect.streaming import exchange as ex
from recollect.streaming import replay as store

AT = datetime(2026, 3, 1, 9)
SESSIONS = store.TABLES["sessions"]


def minutes(n):
    return AT + timedelta(minutes=n)


def note(i, title, sync="", session="", project="p", topic="", content="c"):
    return (i, minutes(i), sync or f"x{i}", session, "bugfix", title, content, "", project, "", topic)


SAVE = "id long, created_at timestamp_ntz, sync_id string, session_id string, type string, title string, content string, tool_name string, project string, scope string, topic_key string"


def fill(spark, folder, notes, sessions=(), prompts=()):
    table = store.table(spark, folder, "observations")
    changes = {"observations": saves.save_batch(table, spark.createDataFrame(notes, SAVE))}
    if sessions:
        changes["sessions"] = spark.createDataFrame([(s, "p", "d", minutes(0), None, "", 3, minutes(0)) for s in sessions], SESSIONS)
    if prompts:
        changes["prompts"] = spark.createDataFrame([(i, s, f"prompt {i}", "p", minutes(i)) for i, s in prompts], store.TABLES["prompts"])
    store.put(spark, folder, changes)


def content(spark, folder):
    o = {(r.project, r.title, r.content, r.topic_key) for r in store.table(spark, folder, "observations").collect()}
    return o, {r.id for r in store.table(spark, folder, "sessions").collect()}, sorted((r.session_id, r.content) for r in store.table(spark, folder, "prompts").collect())


def test_two_sides_converge(spark, tmp_path):
    a, b, shared = f"{tmp_path}/a", f"{tmp_path}/b", f"{tmp_path}/shared"
    fill(spark, a, [note(1, "one", session="s1"), note(2, "both", sync="m"), note(3, "topic a", topic="k"), note(4, "lost", session="s9")], ["s1"], [(1, "s1"), (2, "")])
    fill(spark, b, [note(11, "two"), note(12, "both", sync="n"), note(13, "topic b", topic="k"), note(14, "same id", sync="x1")], ["s2"], [(6, "s2")])
    first = ex.export(spark, a, shared, "a", minutes(5))
    assert first and ex.export(spark, a, shared, "a", minutes(6)) is None
    assert ex.import_new(spark, b, shared, f"{tmp_path}/b-state", minutes(20)) == [first]
    assert ex.import_new(spark, b, shared, f"{tmp_path}/b-state", minutes(21)) == []
    assert ex.import_new(spark, b, shared, f"{tmp_path}/b-other", minutes(21)) == []  # the store knows what it has
    got = {r.title: r for r in store.table(spark, b, "observations").collect()}
    assert set(got) == {"two", "both", "topic a", "same id"}  # x1 is there under another title, s9 is unknown
    assert (got["both"].duplicate_count, got["both"].sync_id, got["topic a"].revision_count) == (2, "n", 2)
    second = ex.export(spark, b, shared, "b", minutes(30))
    assert ex.import_new(spark, a, shared, f"{tmp_path}/a-state", minutes(40)) == [second]
    listed = {r.id: (r.sessions, r.memories, r.prompts) for r in ex.manifest(spark, shared).collect()}
    assert listed[first] == (1, 4, 2) and listed[second][1:] == (4, 1)
    (oa, sa, pa), (ob, sb, pb) = content(spark, a), content(spark, b)
    assert sb == {"s1", "s2"} and ob - oa == {("p", "same id", "c", "")} and {t for _, t, _, _ in oa - ob} == {"one", "lost"}
    assert pb == sorted([("s1", "prompt 1"), ("", "prompt 2"), ("s2", "prompt 6")])


def test_an_import_that_fails_is_made_good(spark, tmp_path, monkeypatch):
    a, b, shared = f"{tmp_path}/a", f"{tmp_path}/b", f"{tmp_path}/shared"
    fill(spark, a, [note(1, "one")], ["s1"], [(1, "s1")])
    ex.export(spark, a, shared, "a", minutes(5))
    fill(spark, a, [note(6, "two"), note(7, "one")], ["s3"])
    ex.export(spark, a, shared, "a", minutes(8))
    applied = ex.apply_chunk

    def broken(spark, folder, shared, name, at, seen=[]):  # noqa: B006
        applied(spark, folder, shared, name, at)
        seen.append(name)
        if len(seen) == 1:
            raise OSError("lost after the commit")

    monkeypatch.setattr(ex, "apply_chunk", broken)
    with pytest.raises(Exception, match="lost after the commit"):
        ex.import_new(spark, b, shared, f"{tmp_path}/state", minutes(9))
    ex.import_new(spark, b, shared, f"{tmp_path}/state", minutes(9))
    assert sorted((r.title, r.duplicate_count) for r in store.table(spark, b, "observations").collect()) == [("one", 1), ("two", 1)]
    assert store.table(spark, b, "prompts").count() == 1


def files(folder):
    return {str(p.relative_to(folder)): p.read_text() for p in folder.rglob("*") if p.is_file()}


def test_files_follow_a_store(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "PARTS", 4)
    folder, out = f"{tmp_path}/store", tmp_path / "notes"
    fill(spark, folder, [note(i, f"Note {i}", project="p" if i % 2 else "q") for i in range(1, 8)])
    assert mirror.follow(spark, folder, str(out), "2026-03-01") == {"write": 7}
    for step in range(2):
        now = store.table(spark, folder, "observations")
        gone = now.filter(F.col("id") == step + 1).withColumn("deleted_at", F.lit(minutes(90)).cast("timestamp_ntz"))
        renamed = now.filter(F.col("id") == step + 2).withColumn("title", F.concat("title", F.lit(" again")))
        store.put(spark, folder, {"observations": gone.unionByName(renamed)})
        fill(spark, folder, [note(100 + step, f"Later {step}", project="r")])
        counts = mirror.follow(spark, folder, str(out), "2026-03-01")
        assert counts["remove"] >= 1 and counts["write"] >= 2
        assert mirror.follow(spark, folder, str(out), "2026-03-01") == {}
        whole = tmp_path / f"whole{step}"
        mirror.export(store.table(spark, folder, "observations"), str(whole), "2026-03-01")
        assert files(out) == files(whole)
    assert "| 7 | [[0007-note-7]] | bugfix | 2026-03-01 |" in files(out)["_index.md"] and "## r (2)" in files(out)["_index.md"]
    one = tmp_path / "one"
    mirror.export(store.table(spark, folder, "observations"), str(one), "2026-03-01", "q")
    assert {p.split("/")[0] for p in files(one)} == {"q", "_index.md"}


def test_no_task_sorts_the_whole_index(spark, tmp_path, monkeypatch):
    rows = [(i, minutes(i * 7 % 50), *note(i, f"Ñote {i % 37}", project="pqr"[i % 3], content=f"c{i}")[2:]) for i in range(1, 301)]
    fill(spark, f"{tmp_path}/store", rows)
    pieces, opened = [], mirror.opened

    def watched(out):  # by the driver, which clears the pieces away
        pieces.extend(tmp_path.glob("notes/_index.md.*.pieces/*"))
        return opened(out)

    monkeypatch.setattr(mirror, "opened", watched)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        mirror.write_index(store.table(spark, f"{tmp_path}/store", "observations"), f"{tmp_path}/notes", "2026-03-01")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(pieces) == 4 and [p.name for p in (tmp_path / "notes").iterdir()] == ["_index.md"]
    wanted = "# Índice de Memoria\n\n> Exportado: 2026-03-01 | Total: 300 observaciones\n\n"
    for project in "pqr":
        wanted += f"## {project} (100)\n\n| ID | Título | Tipo | Fecha |\n|----|--------|------|-------|\n"
        for at, i in sorted((i * 7 % 50, i) for i in range(1, 301) if "pqr"[i % 3] == project):
            wanted += f"| {i} | [[{i:04d}-note-{i % 37}]] | bugfix | 2026-03-01 |\n"
        wanted += "\n"
    assert (tmp_path / "notes/_index.md").read_text() == wanted


def test_tasks_list_files_by_folder(spark, tmp_path):
    found = QUERIES["mirror_files"](spark, "/root/testdata/sf0.001")
    assert found.inputFiles() == []  # the driver has no list of them
    assert found.count() > 0
    names = ["_index.md", "p/bugfix/1.md", "p/bugfix/ñ b.md", "p/a/b/c.md", "q/2.md"]
    for name in names:
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x")
    for out in (str(tmp_path), f"{tmp_path}/", tmp_path.as_uri()):
        assert sorted(r.path for r in mirror.files_below(spark, out).collect()) == sorted(names)
    assert mirror.files_below(spark, f"{tmp_path}/none").count() == 0


def test_only_what_differs_is_written_again(spark, tmp_path):
    folder, out = f"{tmp_path}/store", str(tmp_path / "notes")
    fill(spark, folder, [note(i, f"Note {i}") for i in range(1, 5)])
    mirror.follow(spark, folder, out, "2026-03-01")
    now = store.table(spark, folder, "observations")
    store.put(spark, folder, {"observations": now.withColumn("content", F.when(F.col("id") == 2, "other").otherwise(F.col("content")))})
    assert mirror.follow(spark, folder, out, "2026-03-01") == {"write": 1}
    assert files(tmp_path / "notes")["p/bugfix/0002-note-2.md"].endswith("\n\nother\n")
