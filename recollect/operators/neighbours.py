"""Nearest neighbours by blocks: exact, without comparing every query with every vector.

Vectors lie in the block of the centroid they are nearest to.  A block keeps
the largest angle of its vectors to the centroid, so the angle between a query
and any of them is at least the query's angle to the centroid less that.  The
blocks that may be nearest are compared first; of the others only those whose
bound reaches the k-th similarity found, or the least one asked for.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import spool, spread
from .vectors import blockwise

#: Centroids, and vectors of a part of a block: a larger block is dealt over several.
CENTROIDS, PART = 256, 8192
#: Queries that meet a part of a block at once.
QUERIES = 1000
#: Blocks of a query that are compared before any bound is known.
FIRST = 2
#: Similarities are compared after rounding to six places.
MARGIN = 1e-5


def rows_of(column: pa.Array) -> list[np.ndarray]:
    return [np.array(v, float) if v is not None and None not in v else np.zeros(0) for v in column.to_pylist()]


def centroids(vectors: DataFrame, n: int) -> np.ndarray:
    """At most ``n`` unit vectors: those of the smallest hashes, a bounded sample that any table gives."""
    picked = vectors.orderBy(F.xxhash64("embedding"), F.xxhash64("id")).limit(n)
    rows = [np.array(r.embedding, float) for r in picked.select("embedding").collect() if r.embedding and None not in r.embedding]
    dims = [len(v) for v in rows]
    common = max(set(dims), key=dims.count) if dims else 0
    rows = [v / np.linalg.norm(v) for v in rows if len(v) == common and np.linalg.norm(v) > 0]
    return np.array(rows).reshape(len(rows), common)


def placed(vectors: DataFrame, centres: np.ndarray, every: bool) -> DataFrame:
    """(id, embedding, block, angle): the nearest centroid of each vector, or with ``every`` a row for each; vectors of no length or another dimension are left out."""
    kind = dict(vectors.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = rows_of(batch.column("embedding"))
            at = [i for i, v in enumerate(rows) if len(centres) and len(v) == centres.shape[1] and np.isfinite(v).all() and v.any()]
            if not at:
                continue
            v = np.array([rows[i] for i in at])
            angles = np.arccos(np.clip(v @ centres.T / np.linalg.norm(v, axis=1)[:, None], -1, 1))
            if every:
                of, block = np.repeat(at, len(centres)), np.tile(np.arange(len(centres)), len(at))
                angle = angles.reshape(-1)
            else:
                of, block = np.array(at), angles.argmin(axis=1)
                angle = angles.min(axis=1)
            part = batch.take(pa.array(of))
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("embedding"), pa.array(block.astype(np.int32)), pa.array(angle)], ["id", "embedding", "block", "angle"])

    return vectors.select("id", "embedding").mapInArrow(run, f"id {kind['id']}, embedding {kind['embedding']}, block int, angle double")


def nearest(vectors: DataFrame, queries: DataFrame, k: int, least: float, n: int = CENTROIDS) -> tuple[DataFrame, DataFrame]:
    """(query_id, id, sim, rk) of the k vectors nearest to each query at ``least`` or more, itself left out, and the pairs that were compared (query_id, block, size).

    The result is that of comparing all: blocks are skipped by a bound, with a
    margin for rounding.  Vectors that are null, of no length, or of another
    dimension than most are no neighbours.
    """
    centres = centroids(vectors, n)
    own = placed(spread(vectors), centres, False)
    own = spool(own, "blocks")
    sizes = own.groupBy("block").agg(F.max("angle").alias("radius"), F.count(F.lit(1)).alias("size"))
    parts = F.ceil(F.col("size") / PART)
    sizes = F.broadcast(spool(sizes.withColumn("parts", parts), "radii"))  # a row for each centroid
    own = own.join(sizes.select("block", "parts"), "block").withColumn("part", F.pmod(F.xxhash64("id"), "parts")).drop("parts")

    asked = placed(queries, centres, True).withColumnRenamed("id", "query_id").join(sizes, "block")
    bound = F.cos(F.greatest(F.col("angle") - F.col("radius"), F.lit(0.0)))
    asked = asked.select("query_id", "block", "size", "parts", bound.alias("bound")).filter(F.col("bound") >= least - MARGIN)
    asked = asked.withColumn("rn", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("bound"), "block")))
    asked = spool(asked, "asked")
    blocks = max(1, -(-queries.count() // QUERIES))
    texts = queries.select(F.col("id").alias("query_id"), "embedding", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("of"))
    own = own.withColumn("of", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def compared(which: DataFrame) -> DataFrame:
        dealt = which.select("query_id", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part")).join(texts, "query_id")
        return blockwise(own, dealt, ["block", "part", "of"], least, k)

    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("sim"), "id"))
    first = spool(compared(asked.filter(F.col("rn") <= FIRST)).withColumn("rk", rank).filter(F.col("rk") <= k), "nearest")
    known = first.filter(F.col("rk") == k).select("query_id", (F.col("sim") - MARGIN).alias("reached"))
    rest = asked.filter(F.col("rn") > FIRST).join(known, "query_id", "left").filter(F.col("reached").isNull() | (F.col("bound") >= F.col("reached")))
    rest = spool(rest.drop("reached"), "rest")
    both = first.drop("rk").unionByName(compared(rest))
    pairs = asked.filter(F.col("rn") <= FIRST).select("query_id", "block", "size").unionByName(rest.select("query_id", "block", "size"))
    return both.withColumn("rk", rank).filter(F.col("rk") <= k), pairs
