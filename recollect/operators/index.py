"""A kept inverted index: segments that are written once, tombstones, merges by size.

A change writes a small segment of the notes that are new or changed, and
tombstones for what they replace and for what is removed; older segments are
neither written nor, but for the number of the notes looked for, read.  When
several segments are of one size class they are merged into one.  The manifest
of each version lists the segments and tombstones that count, with their notes
and tokens, so the statistics of a ranking need no pass over the notes.

    folder/manifest/00000003          segments and tombstones of a version
    folder/segments/<name>/documents  id, dl; sorted by id
    folder/segments/<name>/postings   term, id, tf, dl, project, scope, gone, positions; sorted by term
    folder/tombstones/<name>          segment, id, dl

A version counts once its manifest is complete, so a writer that fails leaves
the version before as it is, and the call can be made again.  Writers of one
folder take turns: a second one that writes the same version fails.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import children, spool, spread, unspool

#: Segments of one size class that are merged, and the factor between classes.
FAN = 4
#: A segment with more than this share of its notes gone is written anew.
GONE = 0.5
#: Up to so many tombstones go to every executor.
BROADCAST = 500_000
MANIFEST = "kind string, name string, n bigint, tokens bigint"
#: What a note brings to the index.
NOTE = ["id", "project", "scope", "deleted_at", "toks"]
DOCUMENTS = "segment string, id bigint, dl int"
POSTINGS = "segment string, term string, id bigint, tf int, dl int, project string, scope string, gone boolean, positions array<int>"
#: Tokens whose postings are made at a time.
AT_ONCE = 1 << 21
#: Up to so many terms are looked up by a filter on the files; more by a join.
LISTED = 2000


def versions(spark: SparkSession, path: str) -> list[str]:
    """Complete versions of an index, oldest first."""
    return sorted(v for v in children(spark, f"{path}/manifest") if "_SUCCESS" in children(spark, f"{path}/manifest/{v}"))


def manifest(spark: SparkSession, path: str) -> list:
    """Segments and tombstones of the last version: a few rows, their number grows with the logarithm of the notes."""
    now = versions(spark, path)
    if not now:
        return []
    return spark.read.schema(MANIFEST).json(f"{path}/manifest/{now[-1]}").collect()


def publish(spark: SparkSession, path: str, rows: list) -> None:
    now = versions(spark, path)
    number = int(now[-1]) + 1 if now else 0
    if f"{number:08d}" in children(spark, f"{path}/manifest"):  # half of one, from a writer that failed
        number += 1
    spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("errorifexists").json(f"{path}/manifest/{number:08d}")


def of_kind(rows: list, kind: str) -> list:
    return [r for r in rows if r[0] == kind]


def write_segment(path: str, documents: DataFrame, postings: DataFrame) -> tuple:
    """Write both tables of a segment; (kind, name, notes, tokens) for the manifest."""
    name = uuid.uuid4().hex[:16]
    folder = f"{path}/segments/{name}"
    own = F.lit(name).alias("segment")
    documents.select(own, "id", "dl").repartitionByRange("id").sortWithinPartitions("id").write.parquet(f"{folder}/documents")
    columns = ["term", "id", "tf", "dl", "project", "scope", "gone", "positions"]
    # small row groups: a reader of some terms skips nearly all of them; a very frequent term spreads over files
    postings.select(own, *columns).repartitionByRange("term", "id").sortWithinPartitions("term", "id").write.option("parquet.block.size", str(4 << 20)).parquet(f"{folder}/postings")
    n, tokens = documents.sparkSession.read.schema(DOCUMENTS).parquet(f"{folder}/documents").agg(F.count(F.lit(1)), F.coalesce(F.sum("dl"), F.lit(0))).first()
    return ("segment", name, n, tokens)


def portions(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with some AT_ONCE values in a list column, one row at least."""
    offsets, at = batch.column(column).offsets.to_numpy(), 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + AT_ONCE, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def inverted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of notes (toks and other columns) the other columns with term, tf and positions: a row for each term of a note, and one without a term for the note."""
    for batch in (part for whole in batches for part in portions(whole, "toks")):
        toks = batch.column("toks")
        starts, names = toks.offsets.to_numpy().astype(np.int64), toks.flatten().dictionary_encode()
        per = np.diff(starts)
        row = np.repeat(np.arange(len(per)), per)
        pos = np.arange(len(row)) - np.repeat(starts[:-1] - starts[0], per)
        key = row * max(len(names.dictionary), 1) + names.indices.to_numpy()
        order = np.argsort(key, kind="stable")  # positions of a term stay in order
        first = np.flatnonzero(np.r_[True, np.diff(key[order]) != 0]) if len(order) else order
        none = np.zeros(len(per), np.int64)
        cuts = np.r_[first, len(order), len(order) + none].astype(np.int32)
        of = pa.array(np.r_[row[order[first]], np.arange(len(per))])
        terms = pa.concat_arrays([names.dictionary.take(names.indices.take(pa.array(order[first]))), pa.nulls(len(per), names.dictionary.type)])
        made = {"term": terms, "tf": pa.array(np.diff(cuts)), "positions": pa.ListArray.from_arrays(pa.array(cuts), pa.array(pos[order].astype(np.int32)))}
        made |= {c: batch.column(c).take(of) for c in batch.schema.names if c != "toks"}
        yield pa.RecordBatch.from_arrays([made[c] for c in INVERTED], INVERTED)


#: Columns of what ``inverted`` makes.
INVERTED = ["term", "id", "tf", "dl", "project", "scope", "gone", "positions"]


def segment_of(path: str, notes: DataFrame) -> tuple:
    """A segment of notes (NOTE).

    Postings of a note need its own row only, so tokens are neither moved nor
    cut twice: both tables are sorted from what one pass has written.
    """
    kind = dict(notes.dtypes)["id"]
    notes = spread(notes).select("id", F.size("toks").alias("dl"), "project", "scope", F.col("deleted_at").isNotNull().alias("gone"), "toks")
    made = spool(notes.mapInArrow(inverted, f"term string, id {kind}, tf int, dl int, project string, scope string, gone boolean, positions array<int>"), "inverted")
    segment = write_segment(path, made.filter("term IS NULL"), made.filter("term IS NOT NULL"))
    unspool(made)
    return segment


def create(notes: DataFrame, path: str) -> None:
    """An index of notes (id, project, scope, deleted_at, toks), which has each id once."""
    publish(notes.sparkSession, path, [segment_of(path, notes)])


def tombstones(spark: SparkSession, path: str, rows: list) -> DataFrame:
    names = [f"{path}/tombstones/{r[1]}" for r in of_kind(rows, "tombs")]
    return spark.read.schema(DOCUMENTS).parquet(*names) if names else spark.createDataFrame([], DOCUMENTS)


def alive(df: DataFrame, spark: SparkSession, path: str, rows: list) -> DataFrame:
    """Rows (segment, id) of which no tombstone says that they are gone."""
    count = sum(r[2] for r in of_kind(rows, "tombs"))
    if not count:
        return df
    dead = tombstones(spark, path, rows).select("segment", "id")
    return df.join(F.broadcast(dead) if count <= BROADCAST else dead, ["segment", "id"], "left_anti")


def read_part(spark: SparkSession, path: str, rows: list, part: str) -> DataFrame:
    schema = DOCUMENTS if part == "documents" else POSTINGS
    names = [f"{path}/segments/{r[1]}/{part}" for r in of_kind(rows, "segment")]
    return spark.read.schema(schema).parquet(*names) if names else spark.createDataFrame([], schema)


def totals(rows: list) -> tuple[int, float]:
    """Notes and their mean length, from the manifest."""
    n = sum(r[2] * (1 if r[0] == "segment" else -1) for r in rows)
    tokens = sum(r[3] * (1 if r[0] == "segment" else -1) for r in rows)
    return n, tokens / n if n else 0.0


def postings(spark: SparkSession, path: str, wanted: Column) -> tuple[DataFrame, tuple[int, float]]:
    """Live postings of the terms that a condition on ``term`` lets through, and ``totals``; only their row groups are read."""
    rows = manifest(spark, path)
    return alive(read_part(spark, path, rows, "postings").filter(wanted), spark, path, rows), totals(rows)


def postings_of(terms: DataFrame, path: str) -> tuple[DataFrame, tuple[int, float]]:
    """The same for a table of terms (term)."""
    spark = terms.sparkSession
    few = [r.term for r in terms.select("term").distinct().limit(LISTED + 1).collect()]
    if len(few) <= LISTED:
        return postings(spark, path, F.col("term").isin(few))
    found, whole = postings(spark, path, F.lit(True))
    return found.join(terms.select("term").distinct(), "term", "left_semi"), whole


def update(path: str, changed: DataFrame, removed: DataFrame | None = None) -> None:
    """Put changed or new notes (NOTE, each id once) in and take those named in ``removed`` (id) out; then merge what is due.

    An id that is both counts as changed.  The same call again changes nothing
    but the names of files.
    """
    spark = changed.sparkSession
    rows = manifest(spark, path)
    ids = changed.select("id") if removed is None else changed.select("id").unionByName(removed.select("id")).distinct()
    low, high = ids.agg(F.min("id"), F.max("id")).first()
    made = list(rows)
    if rows and low is not None:
        # documents are sorted by id: row groups outside the range of the changes are skipped
        old = read_part(spark, path, rows, "documents").filter(F.col("id").between(low, high)).join(ids, "id", "left_semi")
        dead = alive(old, spark, path, rows).select("segment", "id", "dl")
        name = uuid.uuid4().hex[:16]
        dead.write.parquet(f"{path}/tombstones/{name}")
        n, tokens = spark.read.schema(DOCUMENTS).parquet(f"{path}/tombstones/{name}").agg(F.count(F.lit(1)), F.coalesce(F.sum("dl"), F.lit(0))).first()
        if n:
            made.append(("tombs", name, n, tokens))
    fresh = segment_of(path, changed)
    if fresh[2]:
        made.append(fresh)
    publish(spark, path, merged(spark, path, made))


def size_class(n: int) -> int:
    return int(math.log(max(n, 1), FAN))


def due(spark: SparkSession, path: str, rows: list) -> list:
    """Segments to merge: FAN or more of one size class, or one of which most is gone."""
    segments = of_kind(rows, "segment")
    classes: dict[int, list] = {}
    for r in segments:
        classes.setdefault(size_class(r[2]), []).append(r)
    for same in (classes[c] for c in sorted(classes)):
        if len(same) >= FAN:
            return same
    dead = {r.segment: r.n for r in tombstones(spark, path, rows).groupBy("segment").agg(F.count(F.lit(1)).alias("n")).collect()} if of_kind(rows, "tombs") else {}
    return [r for r in segments if dead.get(r[1], 0) > GONE * r[2]]


def merged(spark: SparkSession, path: str, rows: list) -> list:
    """The manifest after all merges that are due."""
    while some := due(spark, path, rows):
        rest = [r for r in of_kind(rows, "segment") if r not in some]
        tombs = of_kind(rows, "tombs")
        fresh = write_segment(path, *(alive(read_part(spark, path, some, part), spark, path, tombs) for part in ("documents", "postings")))
        rows = rest + ([fresh] if fresh[2] else [])
        if tombs and rest:
            # what was gone from the other segments still is
            left = tombstones(spark, path, tombs).filter(F.col("segment").isin([r[1] for r in rest]))
            name = uuid.uuid4().hex[:16]
            left.coalesce(1 + sum(r[2] for r in tombs) // BROADCAST).write.parquet(f"{path}/tombstones/{name}")
            n, tokens = spark.read.schema(DOCUMENTS).parquet(f"{path}/tombstones/{name}").agg(F.count(F.lit(1)), F.coalesce(F.sum("dl"), F.lit(0))).first()
            rows += [("tombs", name, n, tokens)] if n else []
    return rows


def vacuum(spark: SparkSession, path: str, drop) -> None:
    """Delete, by ``drop(spark, folder)``, versions before the last and what only they or a failed writer need, once no reader has them open."""
    now = versions(spark, path)
    names = {r[1] for r in manifest(spark, path)}
    for part in ("segments", "tombstones"):
        for name in set(children(spark, f"{path}/{part}")) - names:
            drop(spark, f"{path}/{part}/{name}")
    for version in set(children(spark, f"{path}/manifest")) - set(now[-1:]):
        drop(spark, f"{path}/manifest/{version}")


def any_of(terms: list[str], starts: list[str]) -> Column:
    """Terms that are in a list or begin with one of some prefixes; both are pushed to the files."""
    return reduce(lambda a, b: a | b, [F.col("term").isin(terms), *(F.col("term").startswith(p) for p in starts)])
