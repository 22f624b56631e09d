"""Relations between observations: candidates, verdicts, lists, statistics, collection of dead ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import spool
from ..sources.tables import VERBS
from .index import postings_of as postings_of_index
from .matching import best_matches, lists_of, word_lists
from .observations import latest, live
from .vectors import cosine


def pair_key(a: str = "source_id", b: str = "target_id") -> Column:
    """The same for a pair in either direction."""
    return F.concat_ws("|", F.least(a, b), F.greatest(a, b))


def kept(relations: DataFrame) -> DataFrame:
    """Relations that were not deleted (all of a table that has no such mark)."""
    return relations.filter("deleted_at IS NULL") if "deleted_at" in relations.columns else relations


def enriched(relations: DataFrame, observations: DataFrame) -> DataFrame:
    """Relations that are kept, with id, title and project of both ends, null texts as empty."""
    end = lambda side: observations.select(F.col("sync_id").alias(f"{side}_id"), F.col("id").alias(f"{side}_obs"), F.col("title").alias(f"{side}_title"), F.col("project").alias(f"{side}_project"))
    out = kept(relations).join(end("source"), "source_id", "left").join(end("target"), "target_id", "left")
    texts = [c for c in ("reason", "evidence", "marked_by_actor", "marked_by_kind", "marked_by_model") if c in out.columns]
    return out.withColumns({c: F.coalesce(c, F.lit("")) for c in texts} | {"confidence": F.coalesce("confidence", F.lit(0.0))})


def of_project(relations: DataFrame, observations: DataFrame, project: str | None) -> DataFrame:
    """Relations that are kept; where a project is named, those with an end in it, whichever.

    Only the sync ids of the project's observations meet the relations; a
    relation with both ends there is one row.
    """
    if not project:
        return kept(relations)
    own = observations.filter(F.col("project") == project).select("sync_id").distinct()
    end = lambda side: own.select(F.col("sync_id").alias(f"{side}_id"), F.lit(True).alias(f"{side}_in"))
    out = kept(relations).join(end("source"), "source_id", "left").join(end("target"), "target_id", "left")
    return out.filter("source_in OR target_in").drop("source_in", "target_in")


def listed(relations: DataFrame, observations: DataFrame, project: str | None = None, status: str | None = None) -> DataFrame:
    """Enriched relations, newest first; with an end in a project, and of a status, where these are named."""
    out = kept(relations)
    out = out.filter(F.col("judgment_status") == status) if status else out
    out = enriched(out, observations)
    out = out.filter((F.col("source_project") == project) | (F.col("target_project") == project)) if project else out
    return out.orderBy(F.desc("created_at"), F.desc("id"))


def verb_counts(relations: DataFrame, observations: DataFrame | None = None, project: str | None = None) -> DataFrame:
    """Relations by verb, those still without one left out; with an end in a project where one is named."""
    return of_project(relations, observations, project).filter("relation <> 'pending'").groupBy("relation").agg(F.count(F.lit(1)).alias("n"))


def stats(relations: DataFrame, observations: DataFrame | None = None, project: str | None = None) -> DataFrame:
    """Relations by status, one row; with an end in a project where one is named."""
    count = lambda s: F.coalesce(F.sum((F.col("judgment_status") == s).cast("long")), F.lit(0)).alias(s)
    return of_project(relations, observations, project).agg(F.count(F.lit(1)).alias("total"), count("pending"), count("judged"), count("orphaned"))


def dangling(relations: DataFrame, observations: DataFrame) -> DataFrame:
    """Relations that are kept and of which an end is no live observation."""
    ids = live(observations).select("sync_id")
    out = kept(relations).join(ids.withColumnRenamed("sync_id", "source_id").withColumn("s", F.lit(1)), "source_id", "left")
    out = out.join(ids.withColumnRenamed("sync_id", "target_id").withColumn("t", F.lit(1)), "target_id", "left")
    return out.filter("s IS NULL OR t IS NULL").drop("s", "t")


def collected(relations: DataFrame, observations: DataFrame, at: Column, days: int = 30) -> DataFrame:
    """All relations after a sweep at a time: those with a dead end, and those pending for more than so many days, get deleted_at and updated_at."""
    dead = dangling(relations, observations).select("id")
    old = kept(relations).filter((F.col("judgment_status") == "pending") & (F.col("created_at") < at - F.make_dt_interval(F.lit(days)))).select("id")
    gone = dead.unionByName(old).distinct().withColumn("__gone", F.lit(True))
    out = relations.join(gone, "id", "left")
    return out.withColumns({c: F.when(F.col("__gone"), at).otherwise(F.col(c)) for c in ("deleted_at", "updated_at")}).drop("__gone")


def across_projects(relations: DataFrame, observations: DataFrame) -> DataFrame:
    """Relations whose ends are known and lie in different projects."""
    return enriched(relations, observations).filter("source_project <> target_project")


def judge_by_similarity(relations: DataFrame, vectors: DataFrame, low: float = 0.3, high: float = 0.7) -> DataFrame:
    """Pending relations with a verdict from the cosine of their ends; between the bands they stay pending.

    ``vectors`` has sync_id and embedding; a missing end means not_conflict.
    """
    side = lambda s: vectors.select(F.col("sync_id").alias(f"{s}_id"), F.col("embedding").alias(f"{s}_v"))
    j = relations.filter("judgment_status = 'pending'").join(side("source"), "source_id", "left").join(side("target"), "target_id", "left")
    j = j.withColumn("sim", F.round(cosine(F.col("source_v"), F.col("target_v")), 6))
    missing = F.col("source_v").isNull() | F.col("target_v").isNull()
    verdict = F.when(missing | (F.col("sim") < low), "not_conflict").when(F.col("sim") >= high, "related").otherwise("pending")
    sure = F.when(missing | (F.col("sim") < low), F.lit(0.9)).when(F.col("sim") >= high, F.col("sim"))
    return j.select("id", verdict.alias("verdict"), sure.alias("confidence"))


def apply_verdicts(relations: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Set the verdicts (sync_id, verb) whose verb is valid; of several for one relation, the first by name."""
    good = verdicts.filter(F.col("verb").isin(VERBS)).groupBy("sync_id").agg(F.min("verb").alias("verb"))
    out = relations.join(good, "sync_id", "left")
    return out.withColumn("relation", F.coalesce("verb", "relation")).withColumn("judgment_status", F.when(F.col("verb").isNotNull(), "judged").otherwise(F.col("judgment_status"))).drop("verb")


#: What a verdict says, and the column that it goes to.
SAID = {"verb": "relation", "why": "reason", "evidence": "evidence", "sure": "confidence", "actor": "marked_by_actor", "kind": "marked_by_kind", "model": "marked_by_model", "session": "session_id"}


def judged(relations: DataFrame, observations: DataFrame, verdicts: DataFrame, at: Column) -> DataFrame:
    """Relations after verdicts of agents, with ``error``: why the last verdict on a row was refused, else ''.

    Verdicts have id and verb, and where they say so why, evidence, sure, actor,
    kind, model, session (their order: n, where several may name one relation;
    the last valid one counts).  A verb must be valid, both ends must lie in one
    project (an end that is not there does not count), and a deleted relation
    can't be judged.  A verdict replaces all marks of its row, with null where
    it says nothing; rows without a valid one keep theirs.  Columns that the
    table lacks are added.
    """
    said = [c for c in SAID if c in verdicts.columns]
    order = [F.col("n")] if "n" in verdicts.columns else [F.col(c) for c in said]
    ends = observations.select("sync_id", "project")
    end = lambda side: ends.select(F.col("sync_id").alias(f"{side}_id"), F.col("project").alias(f"__{side}"))
    missing = {c: F.lit(None).cast("double" if c == "confidence" else "string") for c in SAID.values() if c not in relations.columns}
    missing |= {c: F.lit(None).cast("timestamp_ntz") for c in ("updated_at", "deleted_at") if c not in relations.columns}
    rows = relations.withColumns(missing)
    # only rows that are named meet the observations
    named = verdicts.select("id", F.struct(*(c.alias(f"o{i}") for i, c in enumerate(order))).alias("order"), F.struct(*(F.col(c) for c in said)).alias("said"))
    v = named.join(rows.select("id", "source_id", "target_id", "deleted_at"), "id").join(end("source"), "source_id", "left").join(end("target"), "target_id", "left")
    error = F.when(~F.coalesce(F.col("said.verb").isin(VERBS), F.lit(False)), "verb").when(F.col("deleted_at").isNotNull(), "deleted").when(F.col("__source") != F.col("__target"), "project").otherwise("")
    v = v.withColumn("error", error)
    folded = v.groupBy("id").agg(F.max_by("error", "order").alias("error"), F.max_by(F.when(F.col("error") == "", F.col("said")), F.when(F.col("error") == "", F.col("order"))).alias("said"))
    out = rows.join(folded, "id", "left")
    hit = F.col("said").isNotNull()
    new = {SAID[c]: F.col(f"said.{c}") for c in SAID if c in said} | {SAID[c]: F.lit(None) for c in SAID if c not in said}
    new |= {"judgment_status": F.lit("judged"), "updated_at": at}
    out = out.withColumns({c: F.when(hit, value).otherwise(F.col(c)) for c, value in new.items()} | {"error": F.coalesce("error", F.lit(""))})
    return out.drop("said")


def new_ids(pair: Column, at: Column) -> tuple[Column, Column]:
    """(id, sync_id) of a relation that a pair gets at a time, by their digest: a call that comes again makes the same ids."""
    digest = F.md5(F.concat_ws("|", pair, at.cast("string")))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint"), digest


def judge_by_meaning(relations: DataFrame, verdicts: DataFrame, at: Column, actor: str = "engine") -> DataFrame:
    """Relations after a model's verdicts (source_id, target_id, verb, sure, why, model, n), the last of each pair by ``n``.

    A pair that has a relation in either direction keeps its ids and direction
    and takes the verdict; of several the one with the smallest id does.  Other
    pairs are new rows, with ids made from the pair and the time.  Verdicts with
    an unknown verb are passed over, deleted relations neither found nor
    changed, and rows without a verdict keep all their columns.
    """
    good = latest(verdicts.filter(F.col("verb").isin(VERBS)).withColumn("pair", pair_key()), ["pair"], F.desc("n"))
    number, name = new_ids(F.col("pair"), at)
    text, time = "string", "timestamp_ntz"
    wanted = {"sync_id": text, "reason": text, "marked_by_actor": text, "marked_by_kind": text, "marked_by_model": text, "updated_at": time, "deleted_at": time}
    rows = relations.withColumns({c: F.lit(None).cast(kind) for c, kind in wanted.items() if c not in relations.columns})
    marks = {"relation": F.col("verb"), "confidence": F.col("sure"), "reason": F.col("why"), "judgment_status": F.lit("judged"), "marked_by_kind": F.lit("system"), "marked_by_actor": F.lit(actor), "marked_by_model": F.col("model"), "updated_at": at}
    first = latest(kept(rows).withColumn("pair", pair_key()), ["pair"], F.asc("id")).select("pair", "id")
    said = good.select("pair", "source_id", "target_id", "verb", "sure", "why", "model")
    changed = rows.join(said.drop("source_id", "target_id").join(first, "pair"), "id", "left")
    hit = F.col("verb").isNotNull()
    changed = changed.withColumns({c: F.when(hit, value).otherwise(F.col(c)) for c, value in marks.items()}).select(rows.columns)
    new = said.join(first.select("pair"), "pair", "left_anti").withColumns({"id": number, "sync_id": name, "created_at": at} | marks)
    own = ["id", "sync_id", "source_id", "target_id", "created_at", *marks]
    return changed.unionByName(new.select(own), allowMissingColumns=True)


def upsert_symmetric(relations: DataFrame, order: Column) -> DataFrame:
    """One relation of each pair, whichever its direction: the last."""
    return latest(relations.withColumn("pair", pair_key()), ["pair"], order)


def candidates(observations: DataFrame, sources: DataFrame, existing: DataFrame, limit: int = 3, floor: float | None = -2.0, k1: float = 1.2, b: float = 0.75, index_path: str | None = None) -> DataFrame:
    """(src, id, rank, rk): observations whose words match the title of each source, best first.

    ``observations`` has id, sync_id and toks, ``sources`` id, sync_id and terms.
    Where ``observations`` has ``deleted_at``, ``project`` and ``scope``, only
    live rows of the source's project and global ones are candidates (all count
    in the statistics).  Of the documents that share words with a source only
    those that bounds of scores let into the best are scored (``best_matches``).
    With ``index_path`` the words come from a kept index, and the texts are not
    read.  The best ``3 * limit`` are cut first, then those below the floor and
    pairs that exist go, then ``limit`` stay.
    """
    named = sources.select(F.col("id").alias("src"), "terms")
    terms = named.select(F.explode("terms").alias("term"))
    scope = {}
    if {"deleted_at", "project", "scope"} <= set(observations.columns):
        own = sources if "project" in sources.columns else sources.join(observations.select("id", "project"), "id")
        named = own.select(F.col("id").alias("src"), "terms", F.col("project").alias("scope"))
        there = F.col("deleted_at").isNull()
        scope = {"scope": F.when(there, F.col("project")), "shared": there & (F.col("scope") == "global")}
    seen = observations.select("id", *(["toks"] if not index_path else []), *(value.alias(c) for c, value in scope.items()))
    if index_path:
        postings, totals = postings_of_index(terms, index_path)
        lists = spool(lists_of(postings).join(seen, "id"), "words")
    else:
        lists, totals = word_lists(seen, terms, *scope)
    scored = best_matches(lists, totals, named, 3 * limit, k1, b)[0].select("src", "id", F.round(-F.col("score"), 6).alias("rank"))
    top = scored.withColumn("rk", F.row_number().over(Window.partitionBy("src").orderBy("rank", "id"))).filter(F.col("rk") <= 3 * limit)
    top = top.filter(F.col("rank") >= floor) if floor is not None else top
    ids = observations.select("id", "sync_id")
    known = kept(existing).select(pair_key().alias("pair")).distinct()
    top = top.join(ids.toDF("src", "s"), "src").join(ids.toDF("id", "t"), "id").withColumn("pair", pair_key("s", "t")).join(known, "pair", "left_anti")
    return top.withColumn("rk", F.row_number().over(Window.partitionBy("src").orderBy("rank", "id"))).filter(F.col("rk") <= limit).select("src", "id", "rank", "rk")


def pending_rows(found: DataFrame, observations: DataFrame, at: Column) -> DataFrame:
    """New relations of candidates (src, id, rank, rk): pending, from the source to the candidate."""
    ids = observations.select("id", "sync_id")
    j = found.join(ids.toDF("src", "source_id"), "src").join(ids.toDF("id", "target_id"), "id")
    return j.select("source_id", "target_id", F.lit("pending").alias("relation"), F.lit("pending").alias("judgment_status"), F.col("rank").alias("score"), at.alias("created_at"))
