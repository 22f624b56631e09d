"""Exact dedup, decontamination, substring dedup and the Jaccard join against plain Python."""

from pathlib import Path

import brute
import pytest
from pyspark.sql import functions as F

from recollect.llm import decontaminate, exact_dedup, jaccard, substring_dedup
from recollect.sources.scratch import spool

ROWS = brute.corpus()
ITEMS = [(1, ROWS[11][1]), (2, " ".join(f"w{i}" for i in range(30))), (3, None), (4, "w1 w2"), (5, "w1 w2"), (6, ROWS[40][1]), (10, ROWS[-1][1][:300])]


@pytest.fixture(scope="module")
def docs(spark):
    return brute.frame(spark, ROWS).cache()


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(ITEMS, "item_id long, text string")


def test_exact(docs):
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.digest.hex()) for r in exact_dedup.exact_dedup(docs).collect()}
    assert got == brute.copies(ROWS)


def test_exact_compares_bytes_when_digests_are_equal(docs):
    weak = lambda text: F.unhex(F.hex(F.length(text) % 3))
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(docs, digest=weak).collect()}
    assert got == {i: x[:3] for i, x in brute.copies(ROWS).items()}


def test_exact_in_many_batches(docs):
    got = {r.doc_id: r.keep_id for r in exact_dedup.exact_dedup(docs, bytes_per_trigger=1).collect()}
    assert got == {i: x[0] for i, x in brute.copies(ROWS).items()}


def test_exact_keeps_one_of_repeated_rows(spark):
    rows = brute.frame(spark, [(1, "a"), (1, "a"), (None, "a"), (None, "b"), (2, "A")])
    got = exact_dedup.exact_dedup(rows).collect()
    assert len(got) == 5 and sorted((r.doc_id, r.group_size) for r in got if r.kept and r.doc_id) == [(2, 4)]
    twice = exact_dedup.exact_dedup(brute.frame(spark, [(1, "a"), (1, "a")])).collect()
    assert sorted(r.kept for r in twice) == [False, True]


def test_drop_copies_keeps_all_columns(docs):
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, x in brute.copies(ROWS).items() if x[2]}


def test_decontaminate(docs, items):
    got = {r.doc_id: (r.n_words, r.n_hit, list(r["items"])) for r in decontaminate.decontaminate(docs, items).collect()}
    assert got == brute.contaminated(ROWS, ITEMS)


def test_decontaminate_by_joins_without_broadcast(docs, items, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_HASHES", 0)
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", 0)
    got = {r.doc_id: r.n_hit for r in decontaminate.decontaminate(docs, items).collect()}
    assert got == {i: x[1] for i, x in brute.contaminated(ROWS, ITEMS).items()}


def test_decontaminate_repeated_rows_and_null_ids(spark, items):
    rows = brute.frame(spark, [(1, "w1 w2"), (1, "w1 w2"), (1, "other"), (None, "x w1 w2 w1 w2")])
    got = sorted((r.doc_id or 0, r.n_hit) for r in decontaminate.decontaminate(rows, items).collect())
    assert got == [(0, 4), (1, 0), (1, 2), (1, 2)]


def test_substrings(docs):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substring_dedup.remove_repeats(docs).collect()}
    assert got == brute.without_repeats(ROWS)


def test_substrings_of_crowded_anchors(docs, monkeypatch):
    monkeypatch.setattr(substring_dedup, "CROWD", 1)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substring_dedup.remove_repeats(docs).collect()}
    assert got == brute.without_repeats(ROWS)


def test_jaccard(docs):
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard.jaccard_join(docs).collect()}
    assert got == brute.similar(ROWS)


def test_jaccard_finds_a_chain_of_near_copies(spark):
    words = [f"v{i}" for i in range(100)]
    rows = [(i, " ".join(["z"] * 0 + [f"u{i}_{k}" if k < i else words[k] for k in range(100)])) for i in range(12)]
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard.jaccard_join(brute.frame(spark, rows)).collect()}
    assert got == brute.similar(rows)


def test_jaccard_splits_large_buckets(docs, monkeypatch):
    monkeypatch.setattr(jaccard, "SMALL", 3)
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard.jaccard_join(docs).collect()}
    wanted = brute.similar(ROWS)
    assert sum(got[i] == wanted[i] for i in wanted) >= 0.99 * len(wanted)


def test_jaccard_null_ids_and_repeated_rows(spark):
    text = " ".join(f"v{i}" for i in range(20))
    got = jaccard.jaccard_join(brute.frame(spark, [(1, text), (1, text), (2, text + " end"), (None, "alone by itself"), (None, None)])).collect()
    assert sorted((r.doc_id or 0, r.class_id, r.n_links) for r in got if r.doc_id) == [(1, 1, 1), (1, 1, 1), (2, 1, 1)]
    assert [(r.class_id, r.n_links) for r in got if r.doc_id is None] == [(None, 0)] * 2


def test_empty_tables(spark, docs, items):
    none = docs.limit(0)
    assert exact_dedup.exact_dedup(none).count() == 0
    assert decontaminate.decontaminate(none, items).count() == 0
    assert {r.n_hit for r in decontaminate.decontaminate(docs, items.limit(0)).collect()} == {0}
    assert substring_dedup.remove_repeats(none).count() == 0
    assert jaccard.jaccard_join(none).count() == 0


def odd(spark):
    """Repeated rows, ids that several texts share, null ids, and columns named as the operators' own."""
    a, b = " ".join(f"v{i}" for i in range(60)), " ".join(f"u{i}" for i in range(60))
    rows = [(1, a), (1, a), (1, b), (None, a), (None, b + " end"), (None, "alone"), (None, "alone"), (2, "w1 w2 alone"), (3, None), (4, "")]
    return brute.frame(spark, rows).withColumn("__gone", F.lit(1)).withColumn("id", F.lit(1)).withColumn("hash", F.lit(1)), rows


def test_drop_copies_of_odd_rows(spark):
    docs, rows = odd(spark)
    got = exact_dedup.drop_copies(docs)
    assert got.columns == docs.columns
    left = sorted((r.doc_id or 0, r.text or "") for r in got.collect())
    # one row of each text: of the largest id, null below all
    assert [t for _, t in left] == [t for _, t in sorted(left)] and sorted(t for _, t in left) == sorted({t or "" for _, t in rows})
    assert dict((t, i) for i, t in left)[rows[0][1]] == 1 and dict((t, i) for i, t in left)[""] == 4


def test_drop_contaminated_of_odd_rows(spark, items):
    docs, rows = odd(spark)
    got = decontaminate.drop_contaminated(docs, items)
    assert got.columns == docs.columns
    left = sorted(((r.doc_id, r.text) for r in got.collect()), key=str)
    assert left == sorted((x for x in rows if x[1] != "w1 w2 alone"), key=str)  # items 4 and 5 are "w1 w2"


def test_keep_one_of_odd_rows(spark):
    docs, rows = odd(spark)
    more = docs.unionByName(docs.filter("doc_id = 2").withColumn("doc_id", F.lit(9).cast("long")).withColumn("text", F.lit(rows[0][1])))
    got = jaccard.keep_one(more)
    assert got.columns == docs.columns
    left = sorted(((r.doc_id, r.text) for r in got.collect()), key=str)
    assert left == sorted(rows, key=str)  # 9 is a copy of 1; rows without an id stay


def test_substrings_of_hot_anchors(docs, monkeypatch):
    for name, value in {"HOT": 2, "WORDS_AT_ONCE": 500}.items():
        monkeypatch.setattr(substring_dedup, name, value)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substring_dedup.remove_repeats(docs).collect()}
    assert got == brute.without_repeats(ROWS)


@pytest.mark.parametrize("crowd", [1, 2000])
def test_substrings_are_told_apart_by_words(docs, monkeypatch, crowd):
    """Hashes that tell hardly anything apart change no result."""
    import numpy as np

    monkeypatch.setattr(substring_dedup, "CROWD", crowd)
    monkeypatch.setattr(substring_dedup, "gram_hashes", lambda words, n: (words[: max(len(words) - n + 1, 0)] % np.uint64(3)).astype(np.uint64))
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substring_dedup.remove_repeats(docs).collect()}
    assert got == brute.without_repeats(ROWS)


def test_jaccard_of_a_large_group_of_near_copies(spark, monkeypatch):
    """A leaf that no level splits is compared in the pairs of its blocks, each link counted once."""
    monkeypatch.setattr(jaccard, "SMALL", 8)
    words = [f"v{i}" for i in range(200)]
    rows = [(i, " ".join([*words[:100], f"own{i}", *words[100:]])) for i in range(60)]
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard.jaccard_join(brute.frame(spark, rows)).collect()}
    assert got == brute.similar(rows) == {i: (0, 59) for i in range(60)}


@pytest.mark.parametrize("weak", [False, True])
def test_state_stays_between_calls(spark, tmp_path, weak):
    """A later call is compared with all before it, by the bytes that the folder keeps."""
    parts = [ROWS[:50], ROWS[50:51], [], ROWS[51:]]
    digest = (lambda text: F.unhex(F.hex(F.length(text) % 3))) if weak else exact_dedup.sha256_digest
    for i, part in enumerate(parts):
        so_far = brute.copies([x for p in parts[: i + 1] for x in p])
        frame = brute.frame(spark, part) if part else brute.frame(spark, ROWS[:1]).limit(0)
        got = exact_dedup.exact_dedup(frame, digest=digest, state=f"{tmp_path}/state")
        assert {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in got.collect()} == {x: so_far[x][:3] for x, _ in part}


def test_substrings_of_odd_rows(spark):
    """Null ids, repeated rows, and an id that stands for two texts of different lengths."""
    docs, rows = odd(spark)
    long = rows[0][1]
    more = [(7, long + " and more"), (7, long + " and more"), (8, long), (8, "short"), (None, long)]
    got = substring_dedup.remove_repeats(docs.unionByName(brute.frame(spark, more), allowMissingColumns=True)).collect()
    assert len(got) == len(rows) + len(more)
    kept = {(r.doc_id, r.n_words, r.n_removed) for r in got}
    # each row is judged by its own text, also where its id stands for several
    assert {(7, 62, 60), (8, 60, 60), (8, 1, 0), (None, 60, 0)} <= kept
    again = substring_dedup.remove_repeats(brute.frame(spark, [(1, long), (1, long), (7, long + " and more"), (None, long)])).collect()
    assert sorted(((r.doc_id or 0), r.n_removed) for r in again) == [(0, 0), (1, 0), (1, 0), (7, 60)]


@pytest.mark.parametrize("n", range(8))
def test_one_short_text(spark, n):
    text = " ".join(f"w{i}" for i in range(n))
    rows = [(1, text), (2, text)]
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard.jaccard_join(brute.frame(spark, rows).coalesce(1)).collect()}
    assert got == brute.similar(rows)


def test_substrings_of_rows_that_share_an_id(spark):
    """Every row loses what an earlier id has, whatever else its own id stands for."""
    p = " ".join(f"p{i}" for i in range(20))
    rows = [(1, f"{p} a"), (2, f"{p} b"), (2, "other"), (2, f"{p} b"), (3, f"{p} c"), (2, f"x {p}")]
    got = sorted((r.doc_id, r.n_words, r.n_removed) for r in substring_dedup.remove_repeats(brute.frame(spark, rows)).collect())
    assert got == [(1, 21, 0), (2, 1, 0), (2, 21, 20), (2, 21, 20), (2, 21, 20), (3, 21, 20)]


def test_substrings_of_lines_that_repeat(spark, monkeypatch):
    """A text of one line over and over is one anchor's run: it is cut, and its shard stays small."""
    monkeypatch.setattr(substring_dedup, "LONGEST", 16)
    line = "alpha beta gamma delta epsilon "
    rows = [(i, f"own{i} " + line * (30 + i) + f"end{i}") for i in range(12)] + [(50, line * 400)]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substring_dedup.remove_repeats(brute.frame(spark, rows)).collect()}
    assert got == brute.without_repeats(rows)


def test_jaccard_of_rows_that_share_an_id_or_have_none(spark):
    words = [f"v{i}" for i in range(60)]
    m, q, y = " ".join(words), " ".join(f"q{i}" for i in range(60)), " ".join([*words, "y"])
    rows = [(1, m), (1, q), (5, q + " x"), (6, y), (None, m), (7, " ".join(["z", *words])), (None, "alone here"), (None, y)]
    got = sorted(((r.doc_id or 0, r.class_id, r.n_links, r.set_id) for r in jaccard.jaccard_join(brute.frame(spark, rows)).collect()), key=str)
    wanted = [(1, 1, 2, 1), (1, 1, 1, 1), (5, 1, 1, 5), (6, 1, 2, 6), (0, 1, 2, 1), (7, 1, 2, 7), (0, None, 0, None), (0, 1, 2, 6)]
    assert got == sorted(wanted, key=str)


@pytest.mark.parametrize("place", ["move_path", "keyed_state", "join_counted"])
def test_a_call_that_failed_is_made_good(spark, tmp_path, monkeypatch, place):
    """Whatever a call had written, the same call again counts each row once."""
    first, second = ROWS[:40], ROWS[40:]
    state = f"{tmp_path}/state"
    exact_dedup.exact_dedup(brute.frame(spark, first), state=state).count()
    true = getattr(exact_dedup, place)

    def lost(*a, **k):
        if place == "keyed_state":
            true(*a, **k)
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(exact_dedup, place, lost)
        with pytest.raises(OSError):
            exact_dedup.exact_dedup(brute.frame(spark, second), state=state)
    if place != "join_counted":  # there the call was done, only its result was lost
        with pytest.raises(ValueError, match="repeat"):
            exact_dedup.exact_dedup(brute.frame(spark, first[:3]), state=state)
        so_far = brute.copies([*first, *second])
        got = exact_dedup.exact_dedup(brute.frame(spark, second).repartition(5), state=state)
        assert {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in got.collect()} == {x: so_far[x][:3] for x, _ in second}


def test_decontamination_in_slices(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "SLICE", 7)
    items = [(f"i{k}", " ".join(f"w{(k * 37 + j) % 300}" for j in range(n))) for k, n in enumerate([4, 10, 25, 12])]
    rows = [*ROWS, (900, " ".join(f"x{j}" for j in range(40)) + " " + items[2][1] + " tail " + items[0][1]), (901, items[1][1]), (902, "")]
    table = spark.createDataFrame(items, "item_id string, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in decontaminate.decontaminate(brute.frame(spark, rows), table).collect()}
    assert got == brute.contaminated(rows, items)


def test_small_substring_tables_have_the_plan_of_large_ones(spark):
    """Joins that are broadcasts on small tables alone make the shuffle grow faster than the input."""
    text = " ".join(f"w{i}" for i in range(20))
    out = substring_dedup.remove_repeats(spark.createDataFrame([(1, text), (2, text), (3, "one two")], "doc_id long, text string"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    assert {r.doc_id: r.n_removed for r in out.collect()} == {1: 0, 2: 20, 3: 0}


def test_what_a_spool_shuffled_goes_with_it(spark):
    dirs = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    held = lambda: {f for d in dirs for f in Path(d).rglob("shuffle_*.data")}
    before, counts = held(), spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    table = spool(counts, "counts")
    assert not held() - before and table.count() == 7
