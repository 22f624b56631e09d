"""The continuous forms give what the batch forms give."""

from datetime import datetime, timedelta
from uuid import uuid4

import pytest

from recollect.sources import sync
from recollect.streaming import streams


def test_stream_of_first_saves(spark, tmp_path):
    rows = [(i, "p", f"h{i % 5}") for i in range(40)]
    df = spark.createDataFrame(rows, "id long, project string, normalized_hash string")
    df.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    streams.run_available(streams.first_of_each(stream), f"{tmp_path}/out", f"{tmp_path}/state")
    streams.run_available(streams.first_of_each(stream), f"{tmp_path}/out", f"{tmp_path}/state")  # nothing new
    got = spark.read.parquet(f"{tmp_path}/out")
    assert sorted(r.normalized_hash for r in got.collect()) == [f"h{i}" for i in range(5)]


def test_session_windows_close_after_the_gap(spark):
    at = datetime(2026, 1, 1)
    rows = [("a", at + timedelta(minutes=m)) for m in (0, 20, 40, 100)]
    df = spark.createDataFrame(rows, "session_id string, created_at timestamp")
    assert sorted(r.events for r in streams.session_windows(df).collect()) == [1, 3]


def test_chunk_is_imported_once(spark, tmp_path):
    chunk = f"{tmp_path}/{uuid4().hex}"
    rows = spark.createDataFrame([("s1", "", "note"), ("s2", "gone", "cut off")], "sync_id string, session_id string, title string")
    sync.write_chunk(rows, chunk)
    back = sync.read_chunk(spark, chunk, rows.schema)
    sessions = spark.createDataFrame([], "id string")
    fresh = sync.import_new(rows.limit(0), back, sessions)
    assert [r.sync_id for r in fresh.collect()] == ["s1"]
    assert sync.import_new(back, back, sessions).count() == 0


def test_retry_intervals_grow():
    from itertools import islice

    first = list(islice(streams.retry_intervals(), 17))
    assert first == sorted(first) and first[0] == 60 and first[-1] == 3600


def test_intermediate_tables_of_other_threads_are_left_alone(spark):
    import threading

    from recollect.sources import scratch as sc

    start = sc.mark()
    mine = sc.spool(spark.range(3), "mine")
    theirs = []
    other = threading.Thread(target=lambda: theirs.append(sc.spool(spark.range(4), "theirs")))
    other.start()
    other.join()
    paths = mine.inputFiles()
    sc.sweep(spark, start)
    assert theirs[0].count() == 4 and not sc.has_path(spark, paths[0])


def test_streams_follow_events_in_the_order_of_their_times(spark, tmp_path):
    """Shuffled micro-batches under a watermark that lets all of them in: the stream equals the batch; an end removes the state."""
    import random

    from recollect.operators import activity as act
    from recollect.streaming import ordered as od

    rng = random.Random(5)
    at = datetime(2026, 1, 1)
    kinds = ["start", "save", "action", "action", "check", "check", "check", "end"]
    rows = [(f"s{rng.randrange(4)}", i, at + timedelta(seconds=rng.randrange(20_000)), rng.choice(kinds)) for i in range(300)]
    schema = "session_id string, id long, created_at timestamp_ntz, kind string"
    table = spark.createDataFrame(rows, schema)
    shuffled = rng.sample(rows, len(rows))
    for k in range(3):
        spark.createDataFrame(shuffled[k::3], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    spark.createDataFrame([("", -1, at + timedelta(days=30), "check")], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    own = od.stateful(spark)
    for name, made, batch in (
        ("reminders", lambda e: od.reminders(e, 2, 30, "1 day"), act.nudges(table, 2, 30).select("session_id", "id", "reason")),
        ("limits", lambda e: od.limited(e.drop("kind"), ["session_id"], 3, 600, "1 day"), act.rate_limited(table, ["session_id"], 3, 600)),
    ):
        stream = made(own.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"))
        streams.run_available(stream, f"{tmp_path}/{name}", f"{tmp_path}/{name}-state")
        got = spark.read.parquet(f"{tmp_path}/{name}").filter("id >= 0").collect()
        if name == "reminders":
            assert sorted(map(tuple, got)) == sorted(map(tuple, batch.collect())) != []
        else:
            assert {r.id: r.verdict == "admitted" for r in got} == {r.id: r.admitted for r in batch.collect()}
            assert {r.verdict for r in got} == {"admitted", "refused"}


def test_replay_with_edits_between_saves(spark, tmp_path):
    """Edits of rows that saves of one batch make or find keep their place; a batch that comes again changes nothing."""
    import json

    from recollect.streaming import replay as rp

    at = datetime(2026, 1, 1)
    said = lambda title, topic="", session="": {"Title": title, "Content": "c", "Project": "p", "TopicKey": topic, "SessionID": session}
    log = [
        ("create_session", {"ID": "s", "Project": " My P "}), ("save_observation", said("one", "k", "s")), ("update_observation", {"ID": 2, "Title": "two"}), ("save_observation", said("one")),
        ("save_observation", said("two")), ("delete_observation", {"ID": 2}), ("save_observation", said("again", "k")), ("increment_search_count", {"SessionID": "s"}), ("increment_search_count", {"SessionID": "gone"}),
        ("end_session", {"ID": "s", "Summary": "done"}), ("save_prompt", {"SessionID": "gone", "Content": "x", "Project": "p"}), ("save_observation", said("", "")), ("odd", {}),
    ]
    rows = [(i, kind, json.dumps(p), at + timedelta(minutes=i)) for i, (kind, p) in enumerate(log, 1)]
    entries = spark.createDataFrame(rows, "id long, entity_type string, payload string, created_at timestamp_ntz")

    def state(folder):
        o = sorted((r.id, r.title, r.content, r.revision_count, r.duplicate_count, r.deleted_at is not None) for r in rp.table(spark, folder, "observations").collect())
        s = [(r.id, r.project, r.summary, r.search_count, r.ended_at) for r in rp.table(spark, folder, "sessions").collect()]
        return o, s, {r.entry: r.action for r in rp.table(spark, folder, "ledger").collect()}

    whole, parts = f"{tmp_path}/whole", f"{tmp_path}/parts"
    rp.apply_entries(spark, whole, entries)
    wanted = [(2, "two", "c", 2, 2, True), (4, "one", "c", 1, 1, False), (7, "again", "c", 1, 1, False)]
    o, s, ledger = state(whole)
    assert o == wanted and s == [("s", "my-p", "done", 1, at + timedelta(minutes=10))]
    assert ledger[11] == "discard" and ledger[12] == "refuse" and ledger[13] == "corrupt" and len(ledger) == 13
    for ids in ("id <= 5", "id <= 5", "id > 4"):
        rp.apply_entries(spark, parts, entries.filter(ids))
    assert state(parts) == (o, s, ledger)


def test_of_two_streams_the_shorter_does_not_hold_back_the_longer(spark):
    """Calls of two days and prompts that go on for three years: all spans are given, also where one table is empty."""
    from recollect.streaming import ordered as od

    at = datetime(2026, 1, 1)
    schema = "session_id string, id long, created_at timestamp_ntz"
    calls = spark.createDataFrame([("a", i, at + timedelta(hours=i)) for i in range(48)], schema)
    prompts = spark.createDataFrame([("b", i, at + timedelta(days=i)) for i in range(1000)], schema)
    count = lambda x, y: od.through([x, y], 3, streams.activity_windows).filter("session_id <> ''").groupBy("session_id").count().collect()
    assert dict(map(tuple, count(calls, prompts))) == {"a": 48, "b": 1000}
    assert dict(map(tuple, count(calls.limit(0), prompts))) == {"b": 1000}


def test_a_replay_that_fails_is_no_result(spark, monkeypatch):
    """The replay recovers from the loss that is meant; where the batch that comes again fails too, there are no rows."""
    from recollect.plans.registry import QUERIES
    from recollect.streaming import replay as rp

    calls, put = [], rp.put

    def full(*args):
        calls.append(args)
        if len(calls) == 3:
            raise OSError("no space left")
        return put(*args)

    monkeypatch.setattr(rp, "put", full)
    with pytest.raises(Exception, match="no space left"):
        QUERIES["replay_applied"](spark, "/root/testdata/sf0.001")
    assert len(calls) == 3


def test_edits_of_rows_that_a_batch_makes_take_no_turns(spark, tmp_path, monkeypatch):
    """Saves that no other save can find are edited after all of them; one whose text a later save meets, on the way or in the end, keeps its place.  No scratch files are left."""
    import json

    from recollect.sources import scratch
    from recollect.streaming import replay as rp

    at, turns, edited = datetime(2026, 1, 1), [], rp.edited
    monkeypatch.setattr(rp, "edited", lambda *a: (turns.append(1), edited(*a))[1])
    said = lambda title: ("save_observation", {"Title": title, "Content": "c", "Project": "p"})
    edit = lambda i, title: ("update_observation", {"ID": i, "Title": title})
    log = [said(f"t{i}") for i in range(1, 9)]  # 1 to 8
    log += [edit(i, f"new {i}") for i in range(1, 6)] + [edit(14, "too early"), said("late"), edit(1, "twice"), ("delete_observation", {"ID": 2}), edit(2, "gone")]  # 9 to 18; 15 is the late one
    log += [edit(7, "met"), said("met"), edit(7, "elsewhere")]  # 19 to 21: on the way
    rows = [(i, kind, json.dumps(p), at + timedelta(minutes=i)) for i, (kind, p) in enumerate(log, 1)]
    entries = spark.createDataFrame(rows, "id long, entity_type string, payload string, created_at timestamp_ntz")
    before = scratch.mark()
    rp.apply_entries(spark, f"{tmp_path}/store", entries)
    assert scratch.mark() == before and len(turns) == 4  # rows that were there, 19, 21, and all others at once
    got = {r.id: (r.title, r.revision_count, r.duplicate_count, r.deleted_at is not None) for r in rp.table(spark, f"{tmp_path}/store", "observations").collect()}
    assert got == {
        1: ("twice", 3, 1, False), 2: ("new 2", 2, 1, True), 3: ("new 3", 2, 1, False), 4: ("new 4", 2, 1, False), 5: ("new 5", 2, 1, False), 6: ("t6", 1, 1, False),
        7: ("elsewhere", 3, 2, False), 8: ("t8", 1, 1, False), 15: ("late", 1, 1, False),
    }


def test_replay_of_ids_that_saves_give_too(spark, tmp_path):
    """Events from 10,000,000 on, whose ids are those of rows that saves of the same batch make: the rows of the SQL, without a turn for each edit."""
    import os

    from pyspark.sql import functions as F
    from recollect.plans.registry import QUERIES, SQL
    from twins import TABLES, compared, connection

    for name in set(TABLES) - {"events"}:
        os.symlink(f"/root/testdata/sf0.001/{name}.parquet", f"{tmp_path}/{name}.parquet")
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").filter("event_id < 200")
    copies = [events.withColumn("event_id", F.col("event_id") + start) for start in (0, 10_000_000, 30_000_000)]
    copies[0].unionByName(copies[1]).unionByName(copies[2]).coalesce(1).write.parquet(f"{tmp_path}/made")
    os.symlink(next(f"{tmp_path}/made/{f}" for f in os.listdir(f"{tmp_path}/made") if f.endswith(".parquet")), f"{tmp_path}/events.parquet")
    got, wanted = compared(QUERIES["replay_applied"](spark, str(tmp_path)), connection(str(tmp_path)), SQL["replay_applied"])
    assert got == wanted
