"""Vector search and rank fusion."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(n > 0, dot(a, b) / n)


#: Vectors that are compared with a block of queries at once, and rows and columns of one product of matrices.
PART, TILE = 8192, 1024
#: Products of matrices are summed in another order than ``dot``; similarities are compared after rounding to six places.
MARGIN = 1e-5


def matrix(rows: pa.Table, name: str) -> tuple[np.ndarray, dict[int, tuple[np.ndarray, np.ndarray]]]:
    """The ids of a table, and by dimension the places and values of its vectors; those that are null or hold nulls are left out."""
    column = rows.column("embedding").combine_chunks()
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    flat, sizes = column.flatten(), pc.list_value_length(column).fill_null(0).to_numpy()
    ends = np.cumsum(sizes)
    missing = np.concatenate([[0], np.cumsum(flat.is_null().to_numpy(zero_copy_only=False))])
    whole = (sizes > 0) & (missing[ends] == missing[ends - sizes])
    values = flat.fill_null(0).to_numpy().astype(float)
    out = {}
    for d in np.unique(sizes[whole]):
        at = np.flatnonzero(whole & (sizes == d))
        out[int(d)] = at, values[(ends[at] - d)[:, None] + np.arange(d)]
    return rows.column(name).to_numpy(), out


def close_pairs(a: np.ndarray, b: np.ndarray, same: np.ndarray | None, least: float, k: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of two matrices at a cosine of about ``least`` or more: their places and cosines; with ``k`` at least the k nearest rows of ``a`` to each of ``b``.

    Products of matrices tell which pairs may be near enough, a sum in the order
    of ``dot`` gives their cosines.  ``same`` tells pairs that are left out.
    """
    in_order = lambda x, y: reduce(lambda s, d: s + x[:, d] * y[:, d], range(x.shape[1]), np.zeros(len(x)))
    la, lb = np.sqrt(in_order(a, a)), np.sqrt(in_order(b, b))
    found = [(np.zeros(0, int), np.zeros(0, int))]
    with np.errstate(all="ignore"):
        ua, ub = a / la[:, None], b / lb[:, None]
        for j in range(0, len(b), TILE):
            cols = slice(j, j + TILE)
            floor, best = np.full(len(b[cols]), least - MARGIN), np.zeros((0, len(b[cols])))
            for i in range(0, len(a), TILE):
                rows = slice(i, i + TILE)
                sims = ua[rows] @ ub[cols].T
                sims[(la[rows] <= 0), :] = -np.inf
                sims[:, (lb[cols] <= 0)] = -np.inf
                if same is not None:
                    sims[same[rows, cols]] = -np.inf
                if k:
                    best = np.concatenate([best, sims])
                    best = np.partition(best, len(best) - k, axis=0)[-k:] if len(best) > k else best
                    floor = np.fmax(floor, best.min(axis=0) - MARGIN) if len(best) == k else floor
                near = np.nonzero(~(sims < floor))
                found.append((near[0] + i, near[1] + j))
        x, y = (np.concatenate(c) for c in zip(*found))
        sim = np.concatenate([np.zeros(0), *(in_order(a[x[n : n + 65_536]], b[y[n : n + 65_536]]) for n in range(0, len(x), 65_536))]) / (la[x] * lb[y])
    return x, y, sim


def blockwise(vectors: DataFrame, queries: DataFrame, by: list[str], least: float, k: int | None = None) -> DataFrame:
    """(query_id, id, sim) of vectors (by, id, embedding) and queries (by, query_id, embedding) that meet in a block, for the similarities that ``close_pairs`` gives."""
    ids = dict(vectors.dtypes)["id"]
    names = ["query_id", "id", "sim"]

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        both_there = "embedding" in left.column_names and "embedding" in right.column_names  # a side without rows has no columns either
        kind = left.schema.field("id").type if "id" in left.column_names else right.schema.field("query_id").type
        types = [kind, kind, pa.float64()]
        if not both_there:
            return pa.table({c: pa.array([], t) for c, t in zip(names, types)})
        (v_ids, own), (q_ids, asked) = matrix(left, "id"), matrix(right, "query_id")
        out = [(q_ids[:0], v_ids[:0], np.zeros(0))]
        for d in own.keys() & asked.keys():
            (i, a), (j, b) = own[d], asked[d]
            x, y, sim = close_pairs(a, b, np.equal.outer(v_ids[i], q_ids[j]), least, k)
            out.append((q_ids[j][y], v_ids[i][x], sim))
        return pa.table({c: pa.array(np.concatenate(values), t) for c, values, t in zip(names, zip(*out), types)})

    queries = queries.select(*(F.col(c).alias(c) for c in queries.columns))  # both sides may be rows of one table; a column must be of one side
    both = vectors.filter("id IS NOT NULL").groupBy(*by).cogroup(queries.filter("query_id IS NOT NULL").groupBy(*by))
    made = both.applyInArrow(compare, f"query_id {ids}, id {ids}, sim double")
    return made.select("query_id", "id", F.round("sim", 6).alias("sim")).filter(F.col("sim") >= least)


def similar(vectors: DataFrame, queries: DataFrame, least: float, most: int = 1000, k: int | None = None) -> DataFrame:
    """(query_id, id, sim): all vectors at a similarity of ``least`` or more to each query, itself left out.

    Vectors lie in parts and queries in blocks of about ``most``; every part
    meets every block, by products of matrices.  With ``k`` only what may be
    among the k nearest of a query leaves its block.
    """
    parts, blocks = (max(1, -(-df.count() // size)) for df, size in ((vectors, PART), (queries, most)))
    deal = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = vectors.select(deal(parts).alias("part"), every(blocks).alias("block"), "id", "embedding")
    asked = queries.select(deal(blocks).alias("block"), every(parts).alias("part"), F.col("id").alias("query_id"), "embedding")
    return blockwise(own, asked, ["part", "block"], least, k)


def seen(vectors: DataFrame, observations: DataFrame, visible: Column) -> DataFrame:
    """Vectors of observations that a condition on their rows lets through: deleted and foreign notes are no neighbours."""
    return vectors.join(observations.filter(visible).select("id"), "id", "left_semi")


def knn(vectors: DataFrame, queries: DataFrame, k: int, least: float, most: int = 1000) -> DataFrame:
    """(query_id, id, sim, rk): the k vectors nearest to each query, itself left out; each task keeps only its best k."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("sim"), "id"))
    return similar(vectors, queries, least, most, k).withColumn("rk", rank).filter(F.col("rk") <= k)


def prompt_context(near: DataFrame, lexical: DataFrame, injected: DataFrame) -> DataFrame:
    """(id, source): notes to show with a prompt, without those shown before.

    ``near`` are the two nearest vectors at 0.65 or more, ``lexical`` the two
    best text matches; these count only where no vector is left.
    """
    both = near.select("id", F.lit("vector").alias("source")).unionByName(lexical.select("id", F.lit("text").alias("source")))
    left = both.join(injected.select("id").distinct(), "id", "left_anti")
    some = left.agg(F.max((F.col("source") == "vector").cast("int")).alias("some"))  # one row
    return left.crossJoin(F.broadcast(some)).filter((F.col("source") == "vector") | (F.col("some") == 0)).select("id", "source")


def replace_vectors(current: DataFrame, changes: DataFrame) -> DataFrame:
    """(id, embedding, snippet) after changes (id, embedding, content, n): the last of each id; a null embedding removes it."""
    last = changes.groupBy("id").agg(F.max_by(F.struct("embedding", "content"), "n").alias("c"))
    snippet = F.make_valid_utf8(F.substring(F.encode("c.content", "UTF-8"), 1, 100).cast("string"))
    made = last.filter("c.embedding IS NOT NULL").select("id", "c.embedding", snippet.alias("snippet"))
    return current.join(last.select("id"), "id", "left_anti").unionByName(made)


def fuse(*ranked: DataFrame, k: int = 60) -> DataFrame:
    """(id, score) from lists of (id, rk): the sum of 1 / (k + rank)."""
    union = ranked[0].select("id", "rk")
    for r in ranked[1:]:
        union = union.unionByName(r.select("id", "rk"))
    return union.groupBy("id").agg(F.round(F.sum(1.0 / (k + F.col("rk"))), 10).alias("score"))


def ranked(df: DataFrame, *order: Column) -> DataFrame:
    """1-based ranks of a list that is already cut to a page's size."""
    return df.withColumn("rk", F.row_number().over(Window.orderBy(*order)))


def hybrid(lexical: DataFrame, vector: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """A page of the fusion of (id, rank) and (id, rk); each list is fetched to twice the page's end."""
    fetch = (limit + offset) * 2
    lex = ranked(lexical.orderBy("rank", "id").limit(fetch), F.asc("rank"), F.asc("id"))
    return fuse(lex, vector.filter(F.col("rk") <= fetch)).orderBy(F.desc("score"), "id").offset(offset).limit(limit)
