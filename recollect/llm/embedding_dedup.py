"""Near duplicates among embeddings by lattice hashing.

Each table projects a vector onto eight random directions and decodes the
point to the nearest point of the lattice E8, the densest one there: its cell.
A vector lives in its own cell and is also sent to the nearest cells around it
(probes).  Vectors that meet in a cell, one of them at home, are compared by
cosine.  There are as many tables as the target recall takes.  Where a cell
would get too many vectors, several lattice points together name it.

Equal vectors are one class and are compared once.  Projections are sums of
whole numbers, exact in any order, so every task decodes a vector to the same
cells and a pair that meets in several cells is counted in the first of them.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import components
from .common import bounds, give_back, join_counted, ragged, spool, spread, unspool, whole_groups
from .ngrams import mixed

#: Width of the lattice in units of a projected unit vector, and cells around a vector that are probed.
SCALE, PROBES = 1.6, 4
#: Share of unrelated vectors that a cell gets, with its probes, and the rows beyond which cells are named by one more point.
SHARE, CROWD = 0.0035, 8192
#: Cells of more rows are compared as pairs of blocks of about this size, in many tasks.
BLOCK = 1024
#: Bits of a vector's component and of a direction's after rounding to whole numbers: sums stay below 2 ** 53.
BITS_V, BITS_G = 20, 12


def roots() -> np.ndarray:
    """The 240 shortest vectors of E8: steps to the neighbouring lattice points."""
    whole = []
    for i, j in itertools.combinations(range(8), 2):
        for a, b in itertools.product((1.0, -1.0), repeat=2):
            whole.append(np.zeros(8))
            whole[-1][[i, j]] = a, b
    halves = [np.array(s) / 2 for s in itertools.product((1.0, -1.0), repeat=8) if np.prod(s) > 0]
    return np.array(whole + halves)


ROOTS = roots()


def even_point(x: np.ndarray) -> np.ndarray:
    """The nearest points of D8: whole coordinates with an even sum."""
    out = np.rint(x)
    rest = x - out
    odd = np.flatnonzero(out.sum(axis=1) % 2)
    worst = np.abs(rest[odd]).argmax(axis=1)
    out[odd, worst] += np.where(rest[odd, worst] >= 0, 1.0, -1.0)
    return out


def lattice_point(x: np.ndarray) -> np.ndarray:
    """The nearest points of E8, the union of D8 and D8 shifted by one half."""
    a, b = even_point(x), even_point(x - 0.5) + 0.5
    nearer = ((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1)
    return np.where(nearer[:, None], a, b)


def cells(x: np.ndarray, probes: int) -> np.ndarray:
    """For each point its lattice point and then the ``probes`` nearest others around it: points x (1 + probes) x 8."""
    home = lattice_point(x)
    near = (x - home) @ ROOTS.T + np.arange(len(ROOTS)) * 2.0**-40  # ties by the root's number
    best = np.sort(np.argpartition(-near, probes, axis=1)[:, :probes], axis=1) if probes else np.zeros((len(x), 0), int)
    return np.concatenate([home[:, None], home[:, None] + ROOTS[best]], axis=1)


def meeting(threshold: float, probes: int = PROBES, points: int = 20_000) -> float:
    """The chance that two vectors at the threshold meet in one point of one table, by simulation."""
    rng = np.random.default_rng(8)
    x, noise = rng.normal(size=(2, points, 8))
    y = threshold * x + math.sqrt(1 - threshold**2) * noise
    a, b = cells(x / SCALE, probes), cells(y / SCALE, probes)
    return float(((a == b[:, :1]).all(axis=2).any(axis=1) | (b == a[:, :1]).all(axis=2).any(axis=1)).mean())


def points_for(n: int) -> int:
    """Lattice points that name a cell, so that evenly spread vectors give it no more than CROWD rows."""
    return max(1, math.ceil(math.log(max(n, 1) / CROWD) / math.log(1 / SHARE))) if n > CROWD / SHARE else 1


def tables_for(threshold: float, recall: float, points: int) -> int:
    """Tables after which a pair at the threshold has met with this probability."""
    return math.ceil(math.log(1 - recall) / math.log(1 - meeting(threshold) ** points))


def unit(v: np.ndarray) -> np.ndarray:
    return v / np.sqrt((v * v).sum(axis=1))[:, None]


def signature(v: np.ndarray, tables: int, points: int) -> np.ndarray:
    """Numbers of the cells of each vector (all of one dimension), its own cell first: vectors x tables x cells."""
    dim = v.shape[1]
    rounded = np.rint(unit(v) * 2.0**BITS_V)
    out = np.zeros((len(v), tables, (1 + PROBES) ** points), np.uint64)
    for t in range(tables):
        name = np.full((len(v), 1), np.uint64(dim * 1_000_003 + t), np.uint64)
        for p in range(points):
            rng = np.random.default_rng([dim, t, p])
            directions = np.rint(rng.normal(size=(dim, 8)) / SCALE * 2.0**BITS_G)
            x = rounded @ directions * 2.0 ** -(BITS_V + BITS_G) + rng.integers(0, 1024, 8) / 1024
            step = cells(x, PROBES) * 2
            made = np.zeros(step.shape[:2], np.uint64)
            for i in range(8):
                made = mixed(made * np.uint64(0x9E3779B97F4A7C15) + step[:, :, i].astype(np.int64).view(np.uint64))
            name = mixed(name[:, :, None] * np.uint64(0x9E3779B97F4A7C15) + made[:, None, :]).reshape(len(v), -1)
        out[:, t] = name
    return out


def vectors_of(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, dim)


def by_dim(batch: pa.RecordBatch | pa.Table, rows: int) -> Iterator[tuple[np.ndarray, int]]:
    """(positions, dimension) of the rows of a batch, so many at most at a time."""
    dims = np.asarray(batch.column("dim"))
    for dim in np.unique(dims).tolist():
        at = np.flatnonzero(dims == dim)
        for a in range(0, len(at), rows):
            yield at[a : a + rows], dim


def met_before(x: np.ndarray, y: np.ndarray, table: int) -> np.ndarray:
    """Whether vectors x[i] and y[i], by their signatures, meet in an earlier table."""
    out = np.zeros(len(x), bool)
    for t in range(table):
        out |= (x[:, t] == y[:, t, :1]).any(axis=1) | (y[:, t] == x[:, t, :1]).any(axis=1)
    return out


def links(v: np.ndarray, home: np.ndarray, side: np.ndarray, weight: np.ndarray, bucket: np.uint64, table: int, tables: int, points: int, threshold: float) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Links of each vector of one cell to others not met before, by their weights, and pairs that connect those linked."""
    u, n = unit(v), len(v)
    count, root, pairs = np.zeros(n, np.int64), list(range(n)), []
    known = np.full(n, -1)
    names = np.zeros((0, tables, (1 + PROBES) ** points), np.uint64)

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a in range(0, n, BLOCK):
        near = u[a : a + BLOCK] @ u.T >= threshold - 1e-9
        x, y = np.nonzero(near)
        x = x + a
        own = (x < y) & (home[x] | home[y]) & ((side[x] == 0) | (side[x] != side[y]))
        x, y = x[own], y[own]
        for b in range(0, len(x), 1 << 15):  # the pairs at hand, in bounded portions
            p, q = x[b : b + (1 << 15)], y[b : b + (1 << 15)]
            exact = (v[p] * v[q]).sum(axis=1) / np.sqrt((v[p] * v[p]).sum(axis=1) * (v[q] * v[q]).sum(axis=1)) >= threshold
            p, q = p[exact], q[exact]
            new = np.unique(np.r_[p, q])
            new = new[known[new] < 0]
            if len(new):
                known[new] = len(names) + np.arange(len(new))
                names = np.concatenate([names, signature(v[new], tables, points)])
            sx, sy = names[known[p]], names[known[q]]
            # in this table the pair may meet in both home cells: it counts in the one with the smaller number
            hx, hy = sx[:, table, 0], sy[:, table, 0]
            other = np.where(hx == bucket, hy, hx)
            twice = (hx != hy) & (sx[:, table] == hy[:, None]).any(axis=1) & (sy[:, table] == hx[:, None]).any(axis=1)
            mine = ~met_before(sx, sy, table) & ~(twice & (other < bucket))
            p, q = p[mine], q[mine]
            count += np.bincount(p, weight[q], n).astype(np.int64) + np.bincount(q, weight[p], n).astype(np.int64)
            for i, j in zip(p.tolist(), q.tolist()):
                i, j = top(i), top(j)
                if i != j:
                    root[j] = i
                    pairs.append((i, j))
    return count, pairs


def lattice_join(vectors: DataFrame, threshold: float = 0.9, recall: float = 0.995, points: int | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links, component_id, kept.

    ``n_links`` counts the other rows whose vectors have a cosine of
    ``threshold`` or more (of those found: all copies, and pairs at the
    threshold with the probability ``recall``, closer ones with a higher one).
    ``component_id`` is the smallest vec_id linked directly or through others,
    itself included.  ``points`` is the number of lattice points that name a
    cell, by default 1 up to some two million vectors and more beyond.

    Vectors that are null, empty, zero or hold a null, infinite or undefined
    component are linked with nothing and their own component; so are vectors of
    another dimension.  Rows are judged by their own vector: rows that share a
    vec_id, or have none, are rows like others; a null id is never the smallest
    and such a row is not ``kept`` where its component has an id.  Rows that
    repeat are links of one another.  Further columns are ignored; an empty
    table gives no rows.  Cells of any size are compared whole, as pairs of
    blocks in many tasks: the work grows with the square of a group of near but
    different copies, not with that of equal ones.
    """
    kind = dict(vectors.dtypes)[id_col]
    given = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    sound = F.coalesce((F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0), F.lit(False))
    largest = F.aggregate("v", F.lit(0.0), lambda m, x: F.greatest(m, F.abs(x)))
    # by its largest component, so that squares neither overflow nor vanish; cosine does not change
    given = given.withColumn("m", F.when(sound, largest)).withColumn("scaled", F.when((F.col("m") > 1e100) | (F.col("m") < 1e-100), F.transform("v", lambda x: x / F.col("m"))).otherwise(F.col("v")))
    given = given.select("vec_id", F.when(sound, F.transform("scaled", lambda x: x + F.lit(0.0))).alias("v"))

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, packed, dims = [], [], []
            for v, valid in zip(np.split(*split_of(batch.column("v"))), batch.column("v").is_valid().to_pylist()):
                raw = v.tobytes() if valid else None
                keys.append(hashlib.blake2b(raw, digest_size=16).digest() if valid else None)
                packed.append(raw)
                dims.append(len(v) if valid else 0)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(keys, pa.binary()), pa.array(dims, pa.int32()), pa.array(packed, pa.binary())], ["vec_id", "key", "dim", "v"])
        give_back()

    rows = spool(given.mapInArrow(named, f"vec_id {kind}, key binary, dim int, v binary"), "vectors")
    classes = rows.filter("key IS NOT NULL").groupBy("key").agg(F.min("vec_id").alias("first_id"), F.count(F.lit(1)).alias("n"), F.first("dim").alias("dim"), F.first("v").alias("v"))
    classes = spool(classes, "classes")
    points = points or points_for(classes.count())
    tables = tables_for(threshold, recall, points)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        per = (1 + PROBES) ** points
        for batch in batches:
            for at, dim in by_dim(batch, max(1, 200_000 // (tables * per))):
                part = batch.take(pa.array(at))
                names = signature(vectors_of(part.column("v"), dim), tables, points)
                flat = names.reshape(len(at), -1)
                keys = part.column("key").take(pa.array(np.repeat(np.arange(len(at)), flat.shape[1])))
                table = np.tile(np.repeat(np.arange(tables, dtype=np.int32), per), len(at))
                home = np.tile(np.r_[True, np.zeros(per - 1, bool)], len(at) * tables)
                yield pa.RecordBatch.from_arrays([keys, pa.array(table), pa.array(flat.reshape(-1).view(np.int64)), pa.array(home)], ["key", "tbl", "cell", "home"])
        give_back()

    places = spool(classes.select("key", "dim", "v").mapInArrow(placed, "key binary, tbl int, cell bigint, home boolean"), "cells")
    sized = places.groupBy("tbl", "cell").agg(F.count(F.lit(1)).alias("n"), F.max("home").alias("some")).filter("n > 1 AND some").drop("some")
    met = join_counted(places, sized, ["tbl", "cell"])
    # a large cell: a bucket for each pair of its blocks, so that no task has it whole
    cut = met.withColumn("blocks", F.ceil(F.col("n") / BLOCK)).withColumn("block", F.pmod(F.xxhash64("key"), "blocks"))
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    low, high = F.least("block", "other"), F.greatest("block", "other")
    side = F.when(low == high, 0).when(F.col("block") == low, 1).otherwise(2)
    cut = cut.select("key", "tbl", "cell", "home", F.xxhash64("tbl", "cell", low, high).alias("bucket"), side.alias("side"))
    dealt = cut.join(classes.select("key", "dim", "v", F.col("n").alias("weight")), "key").repartition("bucket").sortWithinPartitions("bucket", "tbl", "cell", "key")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in whole_groups(batches, "bucket"):
            group = group.combine_chunks()
            keys, a, b, n = group.column("key").to_pylist(), [], [], []
            bucket, cell, tbl, dims = (group.column(c).to_numpy() for c in ("bucket", "cell", "tbl", "dim"))
            home, side, weight = (group.column(c).to_numpy(zero_copy_only=False) for c in ("home", "side", "weight"))
            # two cells may share a bucket's number: they are told apart
            edges = np.unique(np.r_[bounds(bucket), bounds(cell), bounds(tbl), bounds(dims)])
            for i, j in zip(edges[:-1].tolist(), edges[1:].tolist()):
                if j - i < 2:
                    continue
                v = vectors_of(group.column("v").slice(i, j - i), int(dims[i]))
                count, pairs = links(v, home[i:j], side[i:j], weight[i:j], cell[i : i + 1].view(np.uint64)[0], int(tbl[i]), tables, points, threshold)
                some = np.flatnonzero(count).tolist()
                a += [keys[i + k] for k in some] + [keys[i + p] for p, _ in pairs]
                b += [None] * len(some) + [keys[i + q] for _, q in pairs]
                n += count[some].tolist() + [0] * len(pairs)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(n, pa.int64())], ["a", "b", "n"])
        give_back()

    found = spool(dealt.mapInArrow(compare, "a binary, b binary, n bigint"), "links")
    unspool(places)
    counted = found.filter("b IS NULL").groupBy(F.col("a").alias("key")).agg(F.sum("n").alias("found"))
    parts = components(found.filter("b IS NOT NULL").select("a", "b"))
    whole = classes.select("key", "first_id", "n").join(counted, "key", "left").join(parts.withColumnRenamed("node", "key"), "key", "left")
    whole = spool(whole.select("key", "first_id", "n", F.coalesce("found", F.lit(0)).alias("found"), F.coalesce("root", "key").alias("root")), "parts")
    least = whole.groupBy("root").agg(F.min("first_id").alias("component_id"), F.count(F.lit(1)).alias("n"))
    whole = join_counted(whole.select("key", "root", F.col("n").alias("copies"), "found"), least, ["root"]).select("key", F.col("copies").alias("n"), "found", "component_id")
    known = join_counted(rows.filter("key IS NOT NULL").select("vec_id", "key"), whole, ["key"])
    known = known.select("vec_id", (F.col("n") - 1 + F.col("found")).alias("n_links"), "component_id")
    alone = rows.filter("key IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return known.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def split_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column and the places at which ``numpy.split`` cuts them into rows; null rows are empty."""
    lengths = np.diff(column.offsets.to_numpy())
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    values = column.values.to_numpy(zero_copy_only=False)[ragged(column.offsets.to_numpy()[:-1][valid].astype(np.int64), lengths[valid])]
    return values, np.cumsum(np.where(valid, lengths, 0))[:-1]


def op11_embedding_near_dedup(spark, sf_dir: str) -> DataFrame:
    return lattice_join(spread(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))
