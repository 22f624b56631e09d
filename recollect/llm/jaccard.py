"""N-gram Jaccard join by chosen paths.

Every document is a set of word n-grams.  A run sends each set down a tree:
the node (its path so far) draws which shared token to split on, and sets that
agree on it go on together, until a bucket is small; sets of a small bucket are
compared; one that the last level leaves large is compared in many tasks, one
for each pair of its blocks.  Runs repeat until the chance to meet reaches the
target recall.
Tokens are drawn from min-hash coordinates, so that sets meet at a level with
the probability of their similarity.  Similar pairs of a bucket are then
verified on the full sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import components
from .common import bounds, fits_bytes, give_back, join_counted, list_array, lists, portioned, spool, spread, text_or_empty, unspool, unused, whole_groups
from .ngrams import gram_hashes, mixed, word_hashes

#: Characters between words, after lower-casing A-Z.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
COORDINATES = 64
#: Buckets of more sets are split further, down to DEPTH levels; those still larger are cut into blocks of about this size.
SMALL, DEPTH = 1024, 4
#: Up to so many bytes of ids of sets to verify go to every executor; more are shuffled with the texts.
BROADCAST = 64 << 20
#: Sets that share so much less of their coordinates than the threshold are not verified: four standard errors of the estimate.
SLACK = 4.0
#: Words whose shingles are made at a time.
WORDS_AT_ONCE = 1 << 20
SEEDS = mixed(np.arange(1, 2 * COORDINATES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def shingle_sets(words: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-grams of each document; one gram of all words where there are fewer, none without words."""
    counts = np.diff(offsets)
    grams = gram_hashes(words.view(np.uint64), n)
    doc = np.repeat(np.arange(len(counts)), np.maximum(counts - n + 1, 0))
    at = np.concatenate([np.arange(a, a + c - n + 1) for a, c in zip(offsets[:-1], counts) if c >= n] or [np.zeros(0, int)])
    values = grams[at]
    few = np.flatnonzero((counts > 0) & (counts < n))
    if len(few):
        own = [gram_hashes(np.r_[words[offsets[i] : offsets[i + 1]].view(np.uint64), np.uint64(counts[i])], counts[i] + 1)[0] for i in few]
        doc, values = np.r_[doc, few], np.r_[values, np.array(own, np.uint64)]
    order = np.lexsort((values, doc))
    doc, values = doc[order], values[order]
    new = np.r_[True, (doc[1:] != doc[:-1]) | (values[1:] != values[:-1])] if len(doc) else np.zeros(0, bool)
    doc, values = doc[new], values[new]
    return values, np.r_[0, np.cumsum(np.bincount(doc, minlength=len(counts)))]


def min_hashes(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """COORDINATES numbers for each set; equal with the probability of the Jaccard similarity."""
    out = np.zeros((len(offsets) - 1, COORDINATES), np.uint32)
    full = np.flatnonzero(np.diff(offsets))
    if len(full):
        starts = offsets[full]
        for i in range(COORDINATES):
            h = ((values ^ SEEDS[2 * i]) * (SEEDS[2 * i + 1] | np.uint64(1))) >> np.uint64(32)
            out[full, i] = np.minimum.reduceat(h, starts)
    return out


def runs_for(threshold: float, recall: float) -> int:
    """Runs after which a pair at the threshold has met with this probability, even if all its buckets are split to the last level."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**DEPTH))


def chosen(path, run, level: int):
    """The coordinate that a node splits on: drawn by its path, none twice in a run."""
    return F.pmod(F.xxhash64(path, run, F.lit(level)), F.lit(COORDINATES // DEPTH)) + F.lit(level * (COORDINATES // DEPTH))


def apart(side: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether pairs are of a bucket's own: all of a whole bucket or block (side 0), else those across two blocks."""
    return (side[x] == 0) | (side[x] != side[y])


def met_first(leaves: np.ndarray, x: np.ndarray, y: np.ndarray, run: int) -> np.ndarray:
    """Whether pairs met in no earlier run."""
    return ~(leaves[x, :run] == leaves[y, :run]).any(axis=1)


def in_bytes(table: np.ndarray) -> pa.Array:
    """Each row of a matrix as its bytes."""
    raw, width = np.ascontiguousarray(table).view(np.uint8), table.itemsize * table.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(table), [None, pa.py_buffer(np.arange(0, width * (len(table) + 1), width, dtype=np.int32)), pa.py_buffer(raw)])


def blocks(n: int) -> Iterator[tuple[slice, slice]]:
    for a in range(0, n, SMALL):
        for b in range(a, n, SMALL):
            yield slice(a, min(a + SMALL, n)), slice(b, min(b + SMALL, n))


def likely(sketch: np.ndarray, leaves: np.ndarray, side: np.ndarray, run: int, least: int) -> np.ndarray:
    """Which sets of a bucket agree with another one, not met before, in ``least`` coordinates or more."""
    keep = np.zeros(len(sketch), bool)
    for a, b in blocks(len(sketch)):
        same = np.zeros((a.stop - a.start, b.stop - b.start), np.uint8)
        for i in range(COORDINATES):
            same += sketch[a, i, None] == sketch[None, b, i]
        x, y = np.nonzero(same >= least)
        x, y = x + a.start, y + b.start
        own = (x < y) & apart(side, x, y)
        x, y = x[own], y[own]
        new = met_first(leaves, x, y, run)
        keep[x[new]] = keep[y[new]] = True
    return keep


def linked(sets: list[np.ndarray], leaves: np.ndarray, side: np.ndarray, run: int, threshold: float) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Links of each set of a bucket to others not met before, and pairs that connect those linked."""
    sizes = np.array([len(s) for s in sets])
    flat, tokens = np.repeat(np.arange(len(sets)), sizes), np.concatenate(sets)
    order = np.argsort(tokens, kind="stable")
    doc, starts = flat[order], bounds(tokens[order])
    own = np.empty(len(tokens), np.int64)
    own[order] = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    begins, stops = starts[:-1][own], starts[1:][own]
    count, root, pairs = np.zeros(len(sets), np.int64), list(range(len(sets))), []

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    at = np.r_[0, np.cumsum(sizes)]
    for i in range(len(sets)):
        b, s = begins[at[i] : at[i + 1]], stops[at[i] : at[i + 1]]
        lengths = s - b
        shift = np.repeat(b - np.cumsum(lengths) + lengths, lengths)
        common = np.bincount(doc[shift + np.arange(len(shift))], minlength=len(sets))
        near = np.flatnonzero(common >= threshold * (sizes + sizes[i] - common) - 1e-9)
        near = near[(near > i) & apart(side, np.full(len(near), i), near)]
        near = near[met_first(leaves, np.full(len(near), i), near, run)]
        count[i] += len(near)
        count[near] += 1
        for j in near.tolist():
            p, q = top(i), top(j)
            if p != q:
                root[q] = p
                pairs.append((i, j))
    return count, pairs


def jaccard_join(docs: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.999, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id, n_links, set_id, set_size.

    Documents are linked when the Jaccard similarity of their sets of n-word
    shingles is ``threshold`` or more.  ``class_id`` is the smallest id of the
    documents it is linked to, directly or through others.  Documents with equal
    sets share a ``set_id`` (the smallest id) and are compared once; ``n_links``
    counts the other sets that a set is linked to.  Words are runs of letters
    and digits, ASCII upper case folded; a text of fewer than n words is one
    shingle, one without words (null, empty) is linked to nothing and its own
    class.  Repeated rows share a set.  Inside, a set is known by its digest, so
    each row is compared by its own text: rows that share an id, or have none,
    are linked like others, and a null id is never the smallest (``class_id``
    and ``set_id`` are null only where no row has an id).  An empty table gives
    no rows.
    """
    return with_classes(docs, n, threshold, recall, id_col, text_col).drop("th")


def with_classes(docs: DataFrame, n: int, threshold: float, recall: float, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``jaccard_join`` with ``th``, a hash of the text."""
    kind = dict(docs.dtypes)[id_col]
    docs = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    hashed = docs.select("doc_id", F.xxhash64("text").alias("th"), word_hashes(F.col("text"), GAP, True).alias("words"))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in portioned(whole, "words", WORDS_AT_ONCE)):
            values, offsets = shingle_sets(*lists(batch.column("words")), n)
            full = np.flatnonzero(np.diff(offsets))
            digest = np.zeros((len(offsets) - 1, 2), np.uint64)
            if len(full):
                digest[full, 0] = np.add.reduceat(mixed(values), offsets[full])
                digest[full, 1] = np.bitwise_xor.reduceat(mixed(values * SEEDS[0]), offsets[full])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("th"), in_bytes(digest), pa.array(np.diff(offsets).astype(np.int32)), in_bytes(min_hashes(values, offsets))], ["doc_id", "th", "set", "size", "sketch"])
        give_back()

    rows = spool(hashed.mapInArrow(sketch, f"doc_id {kind}, th bigint, set binary, size int, sketch binary"), "sketches")
    # the row whose text stands for a set: of the smallest id, of those without one if no other has its words
    own = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")
    groups = rows.filter("size > 0").groupBy("set").agg(F.min("doc_id").alias("set_id"), F.count(F.lit(1)).alias("set_size"), F.min(own).alias("own"), F.first("sketch").alias("sketch"))
    groups = spool(groups, "sets")
    reps = groups.select("set", "sketch")

    # paths: all runs at once; buckets of one are dropped, small ones are leaves, others go down a level
    runs = runs_for(threshold, recall)
    value = lambda level: F.substring("sketch", (chosen(F.col("path"), F.col("run"), level) * 4 + 1).cast("int"), F.lit(4))
    start = reps.select("set", F.explode(F.sequence(F.lit(0), F.lit(runs - 1))).alias("run"), "sketch").withColumn("path", F.col("run").cast("long"))
    todo, leaves = start, []
    for level in range(DEPTH):
        step = spool(todo.select("set", "run", F.xxhash64("path", "run", value(level)).alias("path")), "paths")
        sized = step.groupBy("run", "path").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        step = join_counted(step, sized, ["run", "path"])
        leaves.append(step.filter(F.col("n") <= SMALL) if level < DEPTH - 1 else step)
        big = sized.filter(F.col("n") > SMALL)
        if level == DEPTH - 1 or big.isEmpty():
            break
        todo = step.filter(F.col("n") > SMALL).select("set", "run", "path").join(reps, "set")
    placed = leaves[0]
    for more in leaves[1:]:
        placed = placed.unionByName(more)
    placed = spool(placed.select("set", "run", "path", "n"), "leaves")

    # a leaf that is still large: a bucket for each pair of its blocks, so that no task has it whole
    cut = placed.withColumn("blocks", F.ceil(F.col("n") / SMALL)).withColumn("block", F.pmod(F.xxhash64("set"), "blocks"))
    cut = cut.select("set", "run", "path", "blocks", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
    low, high = F.least("block", "other"), F.greatest("block", "other")
    bucket = F.when(F.col("blocks") == 1, F.col("path")).otherwise(F.xxhash64("path", low, high))
    cut = cut.select("set", "run", bucket.alias("bucket"), F.when(low == high, 0).when(F.col("block") == low, 1).otherwise(2).alias("side"))

    # compare the sketches of each bucket: which sets have a partner there that they met in no earlier run
    of_set = placed.groupBy("set").agg(F.map_from_entries(F.collect_list(F.struct("run", "path"))).alias("m"))
    of_set = of_set.select("set", F.expr(f"transform(sequence(0, {runs - 1}), r -> coalesce(m[r], xxhash64(set, r)))").alias("leaves")).join(reps, "set")
    dealt = cut.join(of_set, "set").repartition("bucket").sortWithinPartitions("bucket", "set")
    least = max(1, math.ceil(COORDINATES * (threshold - SLACK * math.sqrt(threshold * (1 - threshold) / COORDINATES))))

    def matrix(column: pa.ChunkedArray) -> np.ndarray:
        return lists(column)[0].reshape(-1, runs)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, "bucket"):
            t = t.combine_chunks()
            met, run, side = matrix(t.column("leaves")), t.column("run").to_numpy(), t.column("side").to_numpy()
            sketches = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint32).reshape(-1, COORDINATES)
            edges = bounds(t.column("bucket").to_numpy())
            keep = np.zeros(t.num_rows, bool)
            for a, b in zip(edges[:-1], edges[1:]):
                keep[a:b] = likely(sketches[a:b], met[a:b], side[a:b], int(run[a]), least)
            yield from t.select(["set", "run", "bucket", "side", "leaves"]).filter(pa.array(keep)).combine_chunks().to_batches()

    close = spool(dealt.mapInArrow(compare, "set binary, run int, bucket bigint, side int, leaves array<bigint>"), "close")

    # verify on the full sets
    wanted = close.select("set").distinct().join(groups.select("set", "own"), "set").select("set", F.col("own.doc_id").alias("id"), F.col("own.th").alias("hash"))
    wanted = F.broadcast(wanted) if fits_bytes(wanted, BROADCAST, F.coalesce(F.octet_length(F.col("id").cast("string")), F.lit(0)), F.lit(48)) else wanted
    texts = docs.withColumn("th", F.xxhash64("text")).join(wanted, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("th") == F.col("hash")))
    texts = texts.select("set", word_hashes(F.col("text"), GAP, True).alias("words")).dropDuplicates(["set"])

    def shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in portioned(whole, "words", WORDS_AT_ONCE)):
            values, offsets = shingle_sets(*lists(batch.column("words")), n)
            yield pa.RecordBatch.from_arrays([batch.column("set"), list_array(values.view(np.int64), offsets, pa.int64())], ["set", "grams"])
        give_back()

    grams = texts.mapInArrow(shingle, "set binary, grams array<bigint>")
    dealt = close.join(grams, "set").repartition("bucket").sortWithinPartitions("bucket", "set")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, "bucket"):
            t = t.combine_chunks()
            side = t.column("side").to_numpy()
            met, run, ids = matrix(t.column("leaves")), t.column("run").to_numpy(), t.column("set").to_pylist()
            values, offsets = lists(t.column("grams"))
            out_a, out_b, out_n = [], [], []
            edges = bounds(t.column("bucket").to_numpy())
            for a, b in zip(edges[:-1], edges[1:]):
                count, pairs = linked([values[offsets[i] : offsets[i + 1]] for i in range(a, b)], met[a:b], side[a:b], int(run[a]), threshold)
                some = np.flatnonzero(count).tolist()
                out_a += [ids[a + i] for i in some] + [ids[a + i] for i, _ in pairs]
                out_b += [None] * len(some) + [ids[a + j] for _, j in pairs]
                out_n += count[some].tolist() + [0] * len(pairs)
            yield pa.RecordBatch.from_pydict({"a": pa.array(out_a, pa.binary()), "b": pa.array(out_b, pa.binary()), "n": pa.array(out_n, pa.int64())})

    found = spool(dealt.mapInArrow(verify, "a binary, b binary, n bigint"), "links")
    links = found.filter("b IS NULL").groupBy(F.col("a").alias("set")).agg(F.sum("n").alias("n_links"))
    roots = components(found.filter("b IS NOT NULL").select("a", "b"))
    # the smallest id of a component; sets that nothing is linked to are their own
    nodes = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())  # a root is in its component too
    joined = spool(nodes.withColumnRenamed("node", "set").join(groups.select("set", "set_id"), "set"), "joined")
    least = joined.groupBy("root").agg(F.min("set_id").alias("class_id"), F.count(F.lit(1)).alias("n"))
    classes = join_counted(joined.select("set", "root"), least, ["root"]).select("set", "class_id")
    sets = groups.select("set", "set_id", "set_size").join(links, "set", "left").join(classes, "set", "left")
    sets = sets.select("set", "set_id", "set_size", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("class_id", "set_id").alias("class_id"))
    sets = spool(sets, "classes")
    unspool(placed, close, joined)
    n_rows = rows.count()
    known = join_counted(rows.filter("size > 0").select("doc_id", "th", "set"), sets.withColumn("n", F.col("set_size")), ["set"], n_rows)
    out = known.select("doc_id", "th", "class_id", "n_links", "set_id", "set_size")
    alone = rows.filter("size = 0").select("doc_id", "th", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.col("doc_id").alias("set_id"), F.lit(1).cast("long").alias("set_size"))
    return out.unionByName(alone)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document, that of the smallest id, of each class; all columns stay.

    Rows are judged by id and text, so of rows that share an id only those
    whose own class has a smaller id go; repeated rows of the document that
    stays all stay (exact copies are another operator's work), and so do rows
    without an id.
    """
    key, text = unused(docs, "id"), unused(docs, "hash")
    gone = with_classes(docs, 5, 0.8, 0.999, id_col, text_col).filter("doc_id <> class_id").select(F.col("doc_id").alias(key), F.col("th").alias(text)).distinct()
    return docs.join(gone, (F.col(id_col) == gone[key]) & (F.xxhash64(text_or_empty(text_col)) == gone[text]), "left_anti")


def op1_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_join(spread(spark.read.parquet(f"{sf_dir}/documents.parquet")))
