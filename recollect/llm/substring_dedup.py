"""Substring deduplication by suffix automata of reference shards.

Every window of ``window`` words that starts in an earlier document too is
removed.  Automata of all documents at every executor would cost the square of
the corpus, so the reference is sharded by content: the smallest k-gram hash of
a window is its anchor, neighbouring windows with one anchor form a segment,
and segments with an anchor of several documents meet in one shard.  A shard's
automaton is built over its distinct segments, each state with the smallest
document it occurs in; segments stream through it, and the matching statistics
give the first document of each window.

Hashes only bring segments together: which are equal is decided on their words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounds, fits, give_back, lists, portioned, portions, ragged, spool, spread, text_or_empty, unspool, whole_groups
from .ngrams import gram_hashes, sliding_min, word_hashes

GAP = r"[\x20\x09-\x0D]+"
#: Words in an anchor, and distinct segments of one anchor above which its segments are cut into single windows.
ANCHOR, CROWD = 4, 2000
#: Bytes of words in a shard, whose automaton takes some 65 MB for each, and in the distinct segments of one anchor above which they are a crowd too.
SHARD_BYTES, CROWD_BYTES = 1 << 20, 4 << 20
#: Windows of a segment: a run of one anchor that goes on (a line that repeats) is cut here.
LONGEST = 1024
#: Up to so many ids go to every executor.
BROADCAST_IDS = 100_000
#: Words that are cut into segments at a time, and segments of one anchor among them above which they are dealt out evenly.
WORDS_AT_ONCE, HOT = 1 << 21, 8


def segments(words: np.ndarray, offsets: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """Document, first word, windows and anchor of each segment."""
    counts = np.diff(offsets)
    per = np.maximum(counts - window + 1, 0)
    starts = ragged(offsets[:-1].astype(np.int64), per)
    if not len(starts):
        return (np.zeros(0, np.int64),) * 4
    anchors = sliding_min(gram_hashes(words.view(np.uint64), ANCHOR), window - ANCHOR + 1)[starts]
    doc = np.repeat(np.arange(len(counts)), per)
    first = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (anchors[1:] != anchors[:-1])])
    runs = np.diff(np.r_[first, len(doc)])
    pieces = -(-runs // LONGEST)
    if len(first) < pieces.sum():
        first = np.repeat(first, pieces) + ragged(np.zeros(len(pieces), np.int64), pieces) * LONGEST
    return doc[first], starts[first] - offsets[doc[first]], np.diff(np.r_[first, len(doc)]), anchors[first].view(np.int64)


def dealt(doc: np.ndarray, anchor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A salt for each segment, and segments that stand for hot anchors.

    An anchor that many segments of these documents have is known to be shared.
    Its segments get a salt and spread over all tasks, and one row without
    windows tells the anchor's own task, so a hot passage makes no hot task.
    """
    order = np.argsort(anchor, kind="stable")
    edges = bounds(anchor[order])
    hot = np.flatnonzero((np.diff(edges) >= HOT) & (doc[order[edges[:-1]]] != doc[order[edges[1:] - 1]]))
    salt = np.zeros(len(anchor), np.int32)
    rows = order[ragged(edges[hot], edges[hot + 1] - edges[hot])]
    salt[rows] = 1 + (rows * 2654435761 % (1 << 30))
    return salt, order[edges[hot]]


def shared_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by anchor and doc_id, those whose anchor is in two documents or more; holds one document's rows at most."""
    held, known = None, None
    for batch in batches:
        salted = batch.column("salt").to_numpy() > 0
        if salted.any():
            yield batch.filter(pa.array(salted)).drop_columns(["salt"])
            batch = batch.filter(pa.array(~salted))
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([held, batch] if held is not None else [batch]).combine_chunks()
        anchor, n = table.column("anchor").to_numpy(), table.column("n").to_numpy()
        edges = bounds(anchor)
        doc = pc.rank(table.column("doc_id"), tiebreaker="dense").to_numpy()
        several = (doc[edges[:-1]] != doc[edges[1:] - 1]) | np.logical_or.reduceat(n == 0, edges[:-1])
        if known is not None and anchor[0] == known:
            several[0] = True
        keep = np.repeat(several, np.diff(edges)) & (n > 0)
        known = anchor[-1] if several[-1] else None
        held = None if several[-1] else table.slice(edges[-2]).combine_chunks().to_batches()[0]
        yield from table.filter(pa.array(keep)).drop_columns(["salt"]).combine_chunks().to_batches()
    give_back()


class Automaton:
    """Suffix automaton of several word sequences; each state has the smallest document that it occurs in."""

    def __init__(self) -> None:
        self.length, self.link, self.next, self.first = [0], [-1], [{}], [None]

    def add(self, sequence: list[bytes], doc) -> None:
        length, link, nexts, first = self.length, self.link, self.next, self.first
        last = 0
        for word in sequence:
            to = nexts[last].get(word)
            if to is not None and length[to] == length[last] + 1:
                last = to
                if first[to] is None or doc < first[to]:
                    first[to] = doc
                continue
            if to is not None:
                clone = len(length)
                length.append(length[last] + 1)
                link.append(link[to])
                nexts.append(nexts[to].copy())
                first.append(doc)
                link[to] = clone
                at = last
                while at >= 0 and nexts[at].get(word) == to:
                    nexts[at][word] = clone
                    at = link[at]
                last = clone
                continue
            new = len(length)
            length.append(length[last] + 1)
            link.append(0)
            nexts.append({})
            first.append(doc)
            at = last
            while at >= 0 and word not in nexts[at]:
                nexts[at][word] = new
                at = link[at]
            if at >= 0:
                to = nexts[at][word]
                if length[to] == length[at] + 1:
                    link[new] = to
                else:
                    clone = len(length)
                    length.append(length[at] + 1)
                    link.append(link[to])
                    nexts.append(nexts[to].copy())
                    first.append(None)
                    link[to] = link[new] = clone
                    while at >= 0 and nexts[at].get(word) == to:
                        nexts[at][word] = clone
                        at = link[at]
            last = new

    def finish(self) -> None:
        """Carry the smallest document from longer to shorter states."""
        first, link = self.first, self.link
        for state in np.argsort(np.array(self.length), kind="stable")[:0:-1].tolist():
            to = link[state]
            if first[to] is None or first[state] < first[to]:
                first[to] = first[state]

    def first_of_windows(self, sequence: list[bytes], window: int) -> list:
        """Matching statistics, cut at ``window`` words: the first document of each window."""
        length, link, nexts, first = self.length, self.link, self.next, self.first
        state, out = 0, []
        for i, word in enumerate(sequence):
            state = nexts[state][word]
            while length[link[state]] >= window:
                state = link[state]
            if i >= window - 1:
                out.append(first[state])
        return out


def named(words: bytes) -> bytes:
    """A key of a word sequence that no two sequences are known to share."""
    return hashlib.blake2b(words, digest_size=16).digest()


def with_words(docs: DataFrame, places: DataFrame, kind: str, window: int) -> DataFrame:
    """``places`` (doc_id, part, start, n, anchor) with the words of each segment and their key."""
    by_doc = places.groupBy("doc_id", "part").agg(F.collect_list(F.struct("start", "n", "anchor")).alias("places"))
    rows = docs.join(by_doc.hint("merge"), ["doc_id", "part"]).select("doc_id", "part", "text", "places")  # one plan at all sizes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in portioned(whole, "places", 50_000)):
            column = batch.column("places")
            per, flat = np.diff(column.offsets.to_numpy()), column.flatten()
            start, n = flat.field("start").to_numpy(), flat.field("n").to_numpy()
            found, at = [], 0
            for text, own in zip(batch.column("text").to_pylist(), per.tolist()):
                words = text.encode().split()  # bytes split at ASCII white space alone
                found += [b" ".join(words[a:b]) for a, b in zip(start[at : at + own].tolist(), (start[at : at + own] + n[at : at + own] + window - 1).tolist())]
                at += own
            of = pa.array(np.repeat(np.arange(len(per)), per))
            keys = pa.array([named(w) for w in found], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(of), batch.column("part").take(of), flat.field("start"), flat.field("n"), flat.field("anchor"), keys, pa.array(found, pa.binary())], ["doc_id", "part", "start", "n", "anchor", "key", "words"])
        give_back()

    return rows.mapInArrow(run, f"doc_id {kind}, part bigint, start int, n int, anchor bigint, key binary, words binary")


def first_documents(distinct: DataFrame, kind: str, window: int) -> DataFrame:
    """(key, first, firsts) of distinct segments (anchor, words, first_doc).

    The smallest document of each window is ``firsts``; that of a segment that
    no other one of its anchor can share windows with is ``first`` for all.
    """

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        for table in whole_groups(batches, "anchor", size=SHARD_BYTES):
            edges = bounds(table.column("anchor").to_numpy())
            sizes = np.r_[0, np.cumsum(pc.binary_length(table.column("words")).to_numpy().astype(np.int64))]
            for a, b in portions(sizes[edges], SHARD_BYTES):
                yield table.slice(edges[a], edges[b] - edges[a])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in shards(batches):
            words, docs = shard.column("words").to_pylist(), shard.column("first_doc").to_pylist()
            edges = bounds(shard.column("anchor").to_numpy())
            met = np.repeat(np.diff(edges) > 1, np.diff(edges)).tolist()
            automaton = Automaton()
            for sequence, doc, several in zip(words, docs, met):
                if several:
                    automaton.add(sequence.split(b" "), doc)
            automaton.finish()
            firsts = [automaton.first_of_windows(sequence.split(b" "), window) if several else None for sequence, several in zip(words, met)]
            doc = shard.column("first_doc").combine_chunks()
            yield pa.RecordBatch.from_arrays([pa.array([named(w) for w in words], pa.binary()), doc, pa.array(firsts, pa.list_(doc.type))], ["key", "first", "firsts"])
        give_back()

    return distinct.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(run, f"key binary, first {kind}, firsts array<{kind}>")


def first_documents_of_crowds(distinct: DataFrame, kind: str, window: int) -> DataFrame:
    """The same for anchors with too many segments for one automaton: each window is grouped by its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in portioned(whole, "words", 1 << 20)):
            keys, pos, of, cut = [], [], [], []
            for i, sequence in enumerate(batch.column("words").to_pylist()):
                words = sequence.split(b" ")
                windows = [b" ".join(words[k : k + window]) for k in range(len(words) - window + 1)]
                keys += [named(sequence)] * len(windows)
                pos += range(len(windows))
                of += [i] * len(windows)
                cut += windows
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(pos, pa.int32()), batch.column("first_doc").take(pa.array(of, pa.int64())), pa.array(cut, pa.binary())], ["key", "pos", "first_doc", "words"])

    single = spool(distinct.mapInArrow(run, f"key binary, pos int, first_doc {kind}, words binary"), "windows")
    once = single.groupBy("words").agg(F.min("first_doc").alias("first"))
    found = single.select("key", "pos", "words").join(once, "words").groupBy("key").agg(F.array_sort(F.collect_list(F.struct("pos", "first"))).alias("f"))
    return found.select("key", F.lit(None).cast(kind).alias("first"), F.col("f.first").alias("firsts"))


def repeated_spans(docs: DataFrame, window: int, kind: str) -> DataFrame:
    """(doc_id, part, covered) of documents (doc_id, part, text), each once: sorted, merged (from, to) word ranges that windows of earlier documents cover."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in portioned(whole, "words", WORDS_AT_ONCE)):
            doc, start, n, anchor = segments(*lists(batch.column("words")), window)
            salt, hot = dealt(doc, anchor)
            more = lambda x, y, t: pa.array(np.r_[x, y].astype(t))
            zero = np.zeros(len(hot))
            of = pa.array(np.r_[doc, doc[hot]])
            yield pa.RecordBatch.from_arrays([more(anchor, anchor[hot], np.int64), batch.column("doc_id").take(of), batch.column("part").take(of), more(start, zero, np.int32), more(n, zero, np.int32), more(salt, zero, np.int32)], ["anchor", "doc_id", "part", "start", "n", "salt"])
        give_back()

    schema = f"anchor bigint, doc_id {kind}, part bigint, start int, n int"
    words = docs.select("doc_id", "part", word_hashes(F.col("text"), GAP, False).alias("words"))
    rows = words.mapInArrow(cut, schema + ", salt int").repartition("anchor", "salt").sortWithinPartitions("anchor", "doc_id").mapInArrow(shared_anchors, schema)
    rows = spool(rows, "segments")
    known = spool(with_words(docs, rows, kind, window), "known")
    unspool(rows)

    distinct = spool(known.groupBy("anchor", "words").agg(F.min("doc_id").alias("first_doc")), "distinct")
    crowded = distinct.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("words")).alias("bytes"))
    crowded = crowded.filter((F.col("n") > CROWD) | (F.col("n") > 1) & (F.col("bytes") > CROWD_BYTES)).select("anchor")
    none = crowded.isEmpty()
    firsts = first_documents(distinct if none else distinct.join(crowded, "anchor", "left_anti"), kind, window)
    if not none:
        firsts = firsts.unionByName(first_documents_of_crowds(distinct.join(crowded, "anchor"), kind, window))

    def covered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start, n, ids = batch.column("start").to_numpy().astype(np.int64), batch.column("n").to_numpy().astype(np.int64), batch.column("doc_id")
            alike = np.flatnonzero(pc.fill_null(pc.less(batch.column("first"), ids), False).to_numpy(zero_copy_only=False) & batch.column("firsts").is_null().to_numpy(zero_copy_only=False))
            firsts = batch.column("firsts")
            per = pc.fill_null(pc.list_value_length(firsts), 0).to_numpy().astype(np.int64)
            row = np.repeat(np.arange(batch.num_rows), per)
            hit = np.flatnonzero(pc.less(firsts.flatten(), ids.take(pa.array(row))).to_numpy(zero_copy_only=False))
            at = start[row] + ragged(np.zeros(len(per), np.int64), per)
            begin = np.r_[True, (np.diff(hit) > 1) | (row[hit[1:]] != row[hit[:-1]])] if len(hit) else np.zeros(0, bool)
            a, b = hit[begin], hit[np.r_[begin[1:], True]] if len(hit) else hit
            of, first, last = np.r_[alike, row[a]], np.r_[start[alike], at[a]], np.r_[start[alike] + n[alike] - 1, at[b]]
            of = pa.array(of)
            yield pa.RecordBatch.from_arrays([ids.take(of), batch.column("part").take(of), pa.array(first.astype(np.int32)), pa.array((last + window).astype(np.int32))], ["doc_id", "part", "a", "b"])

    pieces = known.select("key", "doc_id", "part", "start", "n").join(firsts.hint("merge"), "key").select("doc_id", "part", "start", "n", "first", "firsts").mapInArrow(covered, f"doc_id {kind}, part bigint, a int, b int")
    by_doc = pieces.groupBy("doc_id", "part").agg(F.array_sort(F.collect_set(F.struct("a", "b"))).alias("p"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for spans in batch.column("p").to_pylist():
                merged: list[dict] = []
                for s in spans:
                    if merged and s["a"] <= merged[-1]["b"]:
                        merged[-1]["b"] = max(merged[-1]["b"], s["b"])
                    else:
                        merged.append(s)
                made.append(merged)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("part"), pa.array(made, pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))], ["doc_id", "part", "covered"])

    out = spool(by_doc.mapInArrow(merge, f"doc_id {kind}, part bigint, covered array<struct<a: int, b: int>>"), "covered")
    unspool(known, distinct)
    return out


def remove_repeats(docs: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, kept (text), covered (removed word ranges).

    Words are runs without ASCII white space, unchanged; kept words are joined
    by one space.  A word goes when a window over it also starts in a document
    of a smaller id; windows are judged on the input.  Null texts have no
    words; texts of fewer than ``window`` words stay whole.  Each row is judged
    by its own text: of rows that share an id none is earlier than another, and
    rows that repeat both get equal results.  Rows with a null id neither remove
    nor lose words.  Other columns are ignored, and an empty table gives no rows.
    """
    kind = dict(docs.dtypes)[id_col]
    docs = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    own = docs.filter("doc_id IS NOT NULL")
    # ids of several rows: there a document is an id and a text, by its hash; of others the id names it
    several = spool(own.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("doc_id", F.lit(True).alias("several")), "several")
    none = several.isEmpty()
    shared = F.broadcast(several) if fits(several, BROADCAST_IDS) else several

    def parted(df: DataFrame) -> DataFrame:
        if none:
            return df.withColumn("part", F.lit(0).cast("long"))
        return df.join(shared, "doc_id", "left").withColumn("part", F.when(F.col("several"), F.xxhash64("text")).otherwise(0)).drop("several")

    once = parted(own)
    if not none:
        alike = once.filter("part <> 0").groupBy("doc_id", "part").agg(F.first("text").alias("text"))
        once = once.filter("part = 0").unionByName(alike)
    spans = repeated_spans(once, window, kind)
    out = parted(docs).join(spans.hint("merge"), ["doc_id", "part"], "left").select("doc_id", F.array_remove(F.split("text", GAP), "").alias("words"), F.coalesce("covered", F.array().cast("array<struct<a: int, b: int>>")).alias("covered"))
    # what stays lies between the covered ranges
    left = "zip_with(concat(array(0), covered.b), concat(covered.a, array(size(words))), (b, a) -> slice(words, b + 1, a - b))"
    return out.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.expr("aggregate(covered, 0L, (n, s) -> n + s.b - s.a)").alias("n_removed"),
        F.when(F.size("covered") > 0, F.array_join(F.flatten(F.expr(left)), " ")).otherwise(F.array_join("words", " ")).alias("kept"),
        "covered",
    )


def op10_substring_dedup(spark, sf_dir: str) -> DataFrame:
    out = remove_repeats(spread(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), win AS (
  SELECT doc_id, i, array_to_string(list_slice(w, i, i + 12), ' ') AS s FROM d, unnest(range(1, len(w) - 11)) AS t(i)
), dup AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS f FROM win) WHERE f < doc_id
), gone AS (
  SELECT DISTINCT doc_id, p FROM dup, unnest(range(i, i + 13)) AS t(p)
), word AS (
  SELECT doc_id, p, w[p] AS x FROM d, unnest(range(1, len(w) + 1)) AS t(p)
), kept AS (
  SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS k, count(*) AS n FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""
