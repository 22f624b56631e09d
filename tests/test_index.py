"""The kept index against a rebuild, and pruned matching against scoring of all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from recollect.operators import index as ix
from recollect.operators import matching as mt
from recollect.operators import relations as rl
from recollect.operators import search as se
from recollect.sources.scratch import children, drop_path

NOTE = "id long, title string, content string, type string, project string, scope string, topic_key string, deleted_at timestamp"
WORDS = [f"w{i}" for i in range(60)] + ["of", "the"] * 20
QUERIES = ["w1 OR w2", '"of the"', "w3* NOT w31", "^of OR w5", "(w7 OR w8) the", "nothing", "w1* OR \"the of\""]


def notes(rng, ids):
    text = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    return {i: (i, text(3), text(rng.choice([0, 5, 30])), rng.choice(["bugfix", "pattern"]), rng.choice("pq"), rng.choice(["project", "global"]), "", None) for i in ids}


def ranks(df):
    return [(r.id, round(r.rank, 9)) for r in df.collect()]


def test_changes_leave_what_a_rebuild_has(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ix, "FAN", 3)
    rng = random.Random(1)
    now = notes(rng, range(200))
    path = f"{tmp_path}/index"
    se.write_index(spark.createDataFrame(list(now.values()), NOTE), path)
    old = set(children(spark, f"{path}/segments"))
    for step in range(4):
        changed = notes(rng, rng.sample(sorted(now), 10) + list(range(1000 + step * 10, 1005 + step * 10)))
        removed = rng.sample(sorted(set(now) - set(changed)), 10)
        se.update_index(path, spark.createDataFrame(list(changed.values()), NOTE), spark.createDataFrame([(i,) for i in [*removed, 99_999]], "id long"))
        now = {i: n for i, n in (now | changed).items() if i not in removed}
        if not step:
            assert old < set(children(spark, f"{path}/segments")) and len(ix.of_kind(ix.manifest(spark, path), "segment")) == 2  # the first segment stays as it was
    table = spark.createDataFrame(list(now.values()), NOTE)
    rows = ix.manifest(spark, path)
    sizes = [ix.size_class(r.n) for r in ix.of_kind(rows, "segment")]
    assert all(sizes.count(c) < 3 for c in sizes)
    lengths = [r.n for r in table.select(F.size(se.indexed(table)).alias("n")).collect()]
    assert ix.totals(rows) == (len(now), pytest.approx(sum(lengths) / len(now)))
    ix.vacuum(spark, path, drop_path)
    for query in QUERIES:
        for project in (None, "p"):
            assert ranks(se.search_index(spark, path, query, project)) == ranks(se.search(table, query, project)), (query, project)


def test_a_failed_writer_changes_nothing(spark, tmp_path, monkeypatch):
    rng = random.Random(2)
    first = notes(rng, range(30))
    path = f"{tmp_path}/index"
    se.write_index(spark.createDataFrame(list(first.values()), NOTE), path)
    before = ranks(se.search_index(spark, path, "w1 OR w2"))
    change = spark.createDataFrame(list(notes(rng, range(5, 50)).values()), NOTE)
    for name in ("segment_of", "merged", "publish"):
        with monkeypatch.context() as m:
            m.setattr(ix, name, lambda *a: (_ for _ in ()).throw(OSError("lost")))
            with pytest.raises(OSError):
                se.update_index(path, change)
        assert ranks(se.search_index(spark, path, "w1 OR w2")) == before
    spark.createDataFrame([], ix.MANIFEST).coalesce(1).write.json(f"{path}/manifest/00000001")
    drop_path(spark, f"{path}/manifest/00000001/_SUCCESS")  # half a version
    se.update_index(path, change)
    se.update_index(path, change)
    now = first | {r.id: tuple(r) for r in change.collect()}
    assert ranks(se.search_index(spark, path, "w1 OR w2")) == ranks(se.search(spark.createDataFrame(list(now.values()), NOTE), "w1 OR w2"))


def test_an_empty_index(spark, tmp_path):
    path = f"{tmp_path}/index"
    none = spark.createDataFrame([], NOTE)
    se.write_index(none, path)
    assert ranks(se.search_index(spark, path, "w1")) == []
    se.update_index(path, none, none.select("id"))
    se.update_index(path, spark.createDataFrame([(1, "w1", "", "", "p", "project", "", None), (2, "w2", "", "", "p", "project", "", None), (3, "w2", "", "", "p", "project", "", None)], NOTE))
    assert [i for i, _ in ranks(se.search_index(spark, path, "w1"))] == [1]


def best_of_all(docs, sources, k):
    """The k best of each source by scoring every pair, rounded as the operator does."""
    import math

    n, avgdl = len(docs), sum(len(t) for t in docs.values()) / len(docs)
    df = {}
    for t in docs.values():
        for w in set(t):
            df[w] = df.get(w, 0) + 1
    out = {}
    for src, terms in sources.items():
        scores = []
        for i, toks in docs.items():
            if i == src:
                continue
            score = 0.0
            for w in set(terms):
                tf = toks.count(w)
                if tf:
                    score += max(math.log((n - df[w] + 0.5) / (df[w] + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(toks) / avgdl))
            if score:
                scores.append((round(-score, 6), i))
        out[src] = sorted(scores)[:k]
    return out


def corpus(seed, n=600):
    rng = random.Random(seed)
    words = [f"t{int(400 * rng.random() ** 3)}" for _ in range(n * 20)]
    docs = {i: words[i * 20 : i * 20 + rng.randint(1, 20)] for i in range(n)}
    docs |= {n + i: docs[i] for i in range(40)}  # copies, which tie
    return docs, {i: docs[i][:8] for i in range(0, n, 40)} | {5: ["unknown"], 6: []}


@pytest.mark.parametrize("seed, k", [(1, 3), (2, 9)])
def test_pruned_matches_are_those_of_all_pairs(spark, seed, k):
    docs, sources = corpus(seed)
    frame = spark.createDataFrame(list(docs.items()), "id long, toks array<string>")
    asked = spark.createDataFrame(list(sources.items()), "src long, terms array<string>")
    postings, totals = se.postings_of(frame, asked.select(F.explode("terms").alias("term")))
    scored, pairs = mt.best_matches(postings, totals, asked, k)
    got = {}
    for r in scored.collect():
        got.setdefault(r.src, []).append((round(-r.score, 6), r.id))
    wanted = best_of_all(docs, sources, k)
    assert {s: sorted(x)[:k] for s, x in got.items()} == {s: x for s, x in wanted.items() if x}
    assert pairs.count() < 0.15 * len(docs) * len(sources)


def test_candidates_over_a_kept_index(spark, tmp_path):
    rng = random.Random(4)
    table = spark.createDataFrame([(*n, f"s{n[0]}") for n in notes(rng, range(300)).values()], NOTE + ", sync_id string")
    path = f"{tmp_path}/index"
    se.write_index(table.filter("id < 200"), path)
    se.update_index(path, table.filter("id >= 200"))
    o = table.withColumns({"toks": se.indexed(table), "terms": se.tokens("title")})
    none = spark.createDataFrame([("s1", "s2", None)], "source_id string, target_id string, deleted_at timestamp")
    sources = o.filter("id % 30 = 0").select("id", "sync_id", "project", "terms")
    plain = rl.candidates(o.drop("terms"), sources, none, floor=None).collect()
    kept = rl.candidates(o.drop("terms", "toks"), sources, none, floor=None, index_path=path).collect()
    assert sorted(map(tuple, plain)) == sorted(map(tuple, kept)) != []


def test_matches_of_parts_and_blocks(spark, monkeypatch):
    """Documents in many parts and sources in many blocks, as far as they meet at all, have the matches of all pairs."""
    monkeypatch.setattr(mt, "DOCUMENTS", 50)
    monkeypatch.setattr(mt, "SOURCES", 4)
    docs, sources = corpus(3)
    asked = spark.createDataFrame(list(sources.items()), "src long, terms array<string>")
    postings, totals = se.postings_of(spark.createDataFrame(list(docs.items()), "id long, toks array<string>"), asked.select(F.explode("terms").alias("term")))
    got = {}
    for r in mt.best_matches(postings, totals, asked, 5)[0].collect():
        got.setdefault(r.src, []).append((round(-r.score, 6), r.id))
    assert {s: sorted(x)[:5] for s, x in got.items()} == {s: x for s, x in best_of_all(docs, sources, 5).items() if x}
    assert mt.DOCUMENTS == 50 and mt.scored


def test_postings_of_a_note_need_no_other_row(spark, tmp_path, monkeypatch):
    """Tokens are cut once, in one pass that moves none of them; texts without words and long ones, cut into portions, keep their rows."""
    plans, keep = [], ix.spool
    monkeypatch.setattr(ix, "spool", lambda df, name: (plans.append(df._jdf.queryExecution().executedPlan().toString()), keep(df, name))[1])
    monkeypatch.setattr(ix, "AT_ONCE", 5)
    toks = {1: ["b", "a", "b"], 2: [], 3: ["a"] * 7, 4: ["c", "b"], 5: ["ñ", "b", "ñ"]}
    rows = [(i, "p" if i % 2 else None, "project", None, t) for i, t in toks.items()]
    ix.create(spark.createDataFrame(rows, "id long, project string, scope string, deleted_at timestamp, toks array<string>"), f"{tmp_path}/index")
    assert len(plans) == 1 and "Exchange" not in plans[0] and "Generate" not in plans[0]
    listed = ix.manifest(spark, f"{tmp_path}/index")
    wanted = {(w, i): [k for k, x in enumerate(t) if x == w] for i, t in toks.items() for w in t}
    got = ix.read_part(spark, f"{tmp_path}/index", listed, "postings").collect()
    assert {(r.term, r.id): r.positions for r in got} == wanted and len(got) == len(wanted)
    assert all((r.tf, r.dl, r.project, r.gone) == (len(r.positions), len(toks[r.id]), "p" if r.id % 2 else None, False) for r in got)
    assert {r.id: r.dl for r in ix.read_part(spark, f"{tmp_path}/index", listed, "documents").collect()} == {i: len(t) for i, t in toks.items()}


def test_postings_are_counted_where_words_are_cut(spark, tmp_path):
    """Texts are moved by id, not each of their words; rows that share an id are one note, as in the SQL."""
    from recollect.plans.registry import QUERIES

    rows = [(1, "a b a", "en"), (1, "b c", "en"), (2, "", "es"), (3, None, "en"), (None, "a", "en")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["fts_postings"](spark, str(tmp_path))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == plan.count("Exchange hashpartitioning(id") == 1
    found = {(r.id, r.term): r.tf for r in got.collect()}
    assert (found[1, "a"], found[1, "b"], found[1, "c"], found[None, "a"]) == (4, 4, 2, 2)  # of title and text


def test_what_is_written_of_candidates_grows_with_documents_only(spark, monkeypatch):
    """Documents are not moved to meet sources; rows that share an id, and dead, foreign and global notes, are told apart where the words lie."""
    plans, keep = [], mt.spool
    monkeypatch.setattr(mt, "spool", lambda df, name: (plans.append((name, df._jdf.queryExecution().executedPlan().toString())), keep(df, name))[1])
    monkeypatch.setattr(mt, "SOURCES", 4)
    docs, sources = corpus(5, 300)
    rows = [(i, f"s{i}", "pq"[i % 2], "global" if i % 50 == 0 else "project", "gone" if i % 7 == 3 else None, toks) for i, toks in docs.items()]
    o = spark.createDataFrame(rows, "id long, sync_id string, project string, scope string, deleted_at string, toks array<string>")
    asked = o.filter("id % 40 = 0").select("id", "sync_id", F.slice("toks", 1, 8).alias("terms"))
    none = spark.createDataFrame([("s1", "s2", None)], "source_id string, target_id string, deleted_at string")
    got = sorted((r.src, r.rank, r.id) for r in rl.candidates(o, asked, none, limit=3, floor=None).collect())
    of = {r[0]: r for r in rows}
    wanted = []
    for src, found in best_of_all(docs, {i: docs[i][:8] for i in docs if i % 40 == 0}, len(docs)).items():
        seen = [(rank, i) for rank, i in found if of[i][4] is None and (of[i][2] == of[src][2] or of[i][3] == "global")]
        wanted += [(src, *x) for x in seen[:3]]
    assert got == sorted(wanted) != []
    moved = [name for name, plan in plans if name in ("words", "champions", "survivors") and "Exchange hash" in plan]
    assert moved == [] and [name for name, _ in plans].count("survivors") == 3
    twice = spark.createDataFrame([(1, ["a", "b"]), (1, ["b", "c"]), (2, ["b"]), (1, ["a"])], "id long, toks array<string>")
    posts, totals = se.postings_of(twice, spark.createDataFrame([("a",), ("b",)], "term string"))
    assert sorted((r.id, r.dl, r.term, r.tf) for r in posts.collect()) == [(1, 1, "a", 1), (1, 2, "a", 1), (1, 2, "b", 2), (2, 1, "b", 1)] and totals[0] == 3
