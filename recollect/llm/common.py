"""What the text operators share: ASCII folding, samples, portions of batches, grouped Arrow streams."""

from __future__ import annotations

import contextlib
import ctypes
import string
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import children, drop_path, has_path, move_path, scratch, spool, spread, unspool  # noqa: F401  (of the operators beside)

UPPER, LOWER = string.ascii_uppercase, string.ascii_lowercase


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else.  Pure ASCII texts take the fast path of ``lower``."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def text_or_empty(text_col: str) -> Column:
    return F.coalesce(F.col(text_col).cast("string"), F.lit(""))


def unused(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def some_rows(df: DataFrame, n: int, id_col: str, text_col: str) -> DataFrame:
    """At most ``n`` distinct rows (id, text): those of the smallest hashes.

    Rows that repeat count once, so one id that many rows share can't fill the
    sample or a task.  Only hashes are sorted; texts are fetched for those chosen.
    """
    keys = df.select(F.col(id_col).alias("own"), F.xxhash64(text_or_empty(text_col)).alias("th")).withColumn("rank", F.xxhash64("own", "th"))
    total = df.count()
    if total > 16 * n:  # a share of all hashes that has enough rows, before they are sorted
        keys = keys.filter(F.pmod("rank", F.lit(total // (16 * n))) == 0)
    keys = keys.distinct().orderBy("rank", "own", "th").limit(n)
    rows = df.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    found = rows.join(F.broadcast(keys), F.col("id").eqNullSafe(F.col("own")) & (F.xxhash64("text") == F.col("th")))
    return found.groupBy("id", "th").agg(F.first("text").alias("text")).select("id", "text")


#: Keys with more than this share of all rows are hot: at most so many, whatever the table.
HOT_KEYS = 1000


def join_counted(rows: DataFrame, groups: DataFrame, keys: list[str], total: int | None = None) -> DataFrame:
    """``rows`` joined to ``groups``, which has each key once and counts in ``n`` its rows of ``total`` (those of ``rows`` unless given).

    Rows of the hot keys are joined where they are: these groups, a thousand at
    most, go to every executor, so no task has all rows of one key.
    """
    hot = F.broadcast(groups.filter(F.col("n") > (total or rows.count()) / HOT_KEYS))
    return rows.join(hot, keys).unionByName(rows.join(hot.select(keys), keys, "left_anti").join(groups, keys))


def fits(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` has at most so many rows; decides on a broadcast without reading further."""
    return df.limit(rows + 1).count() <= rows


def fits_bytes(df: DataFrame, size: int, *each: Column) -> bool:
    """Whether all rows of ``df``, by the bytes of each that are given, have at most so many."""
    return (df.agg(F.sum(sum(each, F.lit(0)))).first()[0] or 0) <= size if size else False


def lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Flat values and the n + 1 offsets of a list column without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = column.offsets.to_numpy()
    return column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]], offsets - offsets[0]


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Flat bytes and the n + 1 offsets of a column of texts or bytes without nulls, not copied."""
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8))[offsets[0] : offsets[-1]], offsets - offsets[0]


def list_array(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of each piece, one piece after another."""
    if not len(lengths):
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(ends[-1]) + np.repeat(starts - ends + lengths, lengths)


def portions(offsets: np.ndarray, size: int, rows: int | None = None) -> list[tuple[int, int]]:
    """(from, to) of slices whose offsets differ by ``size`` at most and that have ``rows`` at most, one row at least."""
    at, made, n = 0, [], len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        to = min(to, n, at + (rows or n))
        made.append((at, to))
        at = to
    return made


def portioned(batch: pa.RecordBatch, column: str, size: int, rows: int | None = None) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose text or list ``column`` has so many bytes or elements at most; work on them needs bounded memory."""
    values = batch.column(column)
    lengths = (pc.list_value_length if pa.types.is_list(values.type) else pc.binary_length)(values)
    for a, b in portions(np.r_[0, np.cumsum(pc.fill_null(lengths, 0).to_numpy().astype(np.int64))], size, rows):
        yield batch.slice(a, b - a)


def give_back() -> None:
    """Return this worker's unused memory to the system: it stays alive between tasks, beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def whole_groups(batches: Iterable[pa.RecordBatch], key: str, rows: int = 20_000, size: int = 32 << 20) -> Iterator[pa.Table]:
    """Tables of whole groups from batches sorted by ``key``; several small groups come in one table."""
    held: list[pa.RecordBatch] = []
    n = mb = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n, mb = n + batch.num_rows, mb + batch.nbytes
        if n < rows and mb < size:
            continue
        last = batch.column(key)[batch.num_rows - 1]
        if held[0].column(key)[0].equals(last):
            continue
        table = pa.Table.from_batches(held)
        keys = table.column(key).combine_chunks().to_numpy(zero_copy_only=False)
        cut = int(np.argmax(keys == keys[-1]))
        yield table.slice(0, cut)
        held = table.slice(cut).combine_chunks().to_batches()
        n, mb = sum(b.num_rows for b in held), sum(b.nbytes for b in held)
    if held:
        yield pa.Table.from_batches(held)


def bounds(keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys starts, and the length at the end."""
    if not len(keys):
        return np.zeros(1, np.int64)
    return np.r_[0, np.flatnonzero(keys[1:] != keys[:-1]) + 1, len(keys)]
