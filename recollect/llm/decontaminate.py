"""Benchmark decontamination by winnowing, in DataFrame functions.

A fingerprint is the smallest hash of the k-grams in a sliding window.  With
windows of ``window`` words that hold ``window - k + 1`` k-grams, two equal
windows have equal fingerprints, so every shared span of ``window`` words is
found.  Fingerprints of documents are joined to those of the benchmark;
documents with a hit are then compared window by window, on the words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, fits, fits_bytes, spool, spread, text_or_empty, unused

#: Characters between words, after lower-casing A-Z.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Above so many rows (of 16 bytes) or bytes a table is shuffled, not broadcast.
BROADCAST_HASHES, BROADCAST_WINDOWS = 2_000_000, 32 << 20
#: Windows of a slice: a longer text is worked on in slices that overlap by all but one word of a window.
SLICE = 20_000


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(text), GAP), "")


def sliced(df: DataFrame, window: int, *keep: str) -> DataFrame:
    """``df`` with a row for each slice of ``words`` and its first position (``start``); one row where there are no words."""
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - window, F.lit(0)), F.lit(SLICE))
    cut = df.select(*keep, "words", F.explode(starts).alias("start"))
    return cut.select(*keep, "start", F.when(F.size("words") <= SLICE + window - 1, F.col("words")).otherwise(F.slice("words", F.col("start") + 1, SLICE + window - 1)).alias("words"))


def windowed(array: str, size: int, of: str) -> Column:
    """``of`` for each run of ``size`` elements (``slice`` as {s}, its first position as {i}); empty if there is none."""
    made = of.format(s=f"slice({array}, i, {size})", i="i")
    return F.expr(f"CASE WHEN size({array}) >= {size} THEN transform(sequence(1, size({array}) - {size - 1}), i -> {made}) END")


def runs(array: str, size: int, of: str) -> Column:
    """``of`` (a function of ``size`` values) of each run of neighbours, empty where there is none; no run is copied."""
    values = ", ".join(f"get({array}, i + {j})" for j in range(size))
    made = F.expr(f"CASE WHEN size({array}) >= {size} THEN transform(sequence(0, size({array}) - {size}), i -> {of}({values})) ELSE CAST(array() AS array<bigint>) END")
    return made if size > 1 or of != "least" else F.col(array)


def fingerprinted(df: DataFrame, lengths: list[int], k: int, keep: list[str]) -> DataFrame:
    """Adds ``fps``: the distinct fingerprints of all windows of these lengths in the column ``words``."""
    grams = sorted({min(n, k) for n in lengths})
    df = df.select(*keep, F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"))
    df = df.select(*keep, *(runs("hashes", g, "xxhash64").alias(f"g{g}") for g in grams))
    minima = [runs(f"g{min(n, k)}", n - min(n, k) + 1, "least") for n in lengths]
    return df.select(*keep, F.array_distinct(F.concat(*minima)).alias("fps"))


def benchmark_windows(benchmark: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """Distinct windows: words joined by spaces, length, ids of the items that have it."""
    items = benchmark.select(F.col(id_col).cast("string").alias("item"), words_of(text_or_empty(text_col)).alias("words")).filter("size(words) > 0")
    cut = windowed("words", window, "array_join({s}, ' ')")
    items = items.select("item", F.when(F.size("words") >= window, cut).otherwise(F.array(F.array_join("words", " "))).alias("w"), F.least(F.size("words"), F.lit(window)).alias("len"))
    return items.select("item", "len", F.explode("w").alias("win")).groupBy("win", "len").agg(F.collect_set("item").alias("items"))


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = 10,
    k: int = 5,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_hit, items (sorted array of strings), spans.

    A window is ``window`` consecutive words of a benchmark item, or all words
    of an item with fewer.  ``n_hit`` counts the words inside any occurrence;
    ``spans`` are (first word, length) of the merged occurrences, from 0.  Null texts have no words; items without words have no
    windows; a null item id is never reported but its windows hit; rows that
    repeat an id and text get equal results, rows that share an id but not a
    text get their own.  A very long text is split into words at once, but its
    windows are made in slices.  Either table may be empty.
    """
    return with_hits(docs, benchmark, window, k, id_col, text_col, item_col, item_text_col).drop("th")


def with_hits(docs: DataFrame, benchmark: DataFrame, window: int, k: int, id_col: str, text_col: str, item_col: str, item_text_col: str) -> DataFrame:
    """The rows of ``decontaminate`` with ``th``, a hash of the text."""
    docs = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    docs = docs.select("doc_id", F.xxhash64("text").alias("th"), words_of(F.col("text")).alias("words"))
    wins = spool(benchmark_windows(benchmark, item_col, item_text_col, window), "windows")
    lengths = sorted(r.len for r in wins.select("len").distinct().collect())  # at most ``window`` values
    lengths = lengths or [window]
    prints = fingerprinted(wins.select("len", F.split("win", " ").alias("words")), lengths, k, []).select(F.explode("fps").alias("fp")).distinct()
    prints = F.broadcast(prints.withColumn("hit", F.lit(1))) if fits(prints, BROADCAST_HASHES) else prints.withColumn("hit", F.lit(1))

    # 1. all documents: number of words, and whether any fingerprint is a benchmark's
    rows = docs.withColumn("rid", F.monotonically_increasing_id()).withColumn("n_words", F.size("words").cast("long"))
    rows = fingerprinted(sliced(rows, window, "rid", "doc_id", "th", "n_words"), lengths, k, ["rid", "doc_id", "th", "n_words"])
    rows = rows.select("rid", "doc_id", "th", "n_words", F.explode_outer("fps").alias("fp")).join(prints, "fp", "left")
    rows = spool(rows.groupBy("rid").agg(*(F.max(c).alias(c) for c in ("doc_id", "th", "n_words", "hit"))), "winnowed")

    # 2. documents with a hit: which windows occur, on the words themselves
    found = rows.filter("hit = 1").select(F.col("doc_id").alias("id"), F.col("th").alias("h")).distinct()
    found = F.broadcast(found) if fits(found, BROADCAST_HASHES) else found
    near = docs.join(found, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("th") == F.col("h")), "left_semi")
    starts = [F.coalesce(windowed("words", n, "struct({i} - 1 AS at, array_join({s}, ' ') AS win)"), F.array().cast("array<struct<at: int, win: string>>")) for n in lengths]
    near = sliced(near, window, "doc_id", "th").select("doc_id", "th", "start", F.explode(F.concat(*starts)).alias("s")).select("doc_id", "th", (F.col("start") + F.col("s.at")).alias("at"), "s.win")
    few = fits_bytes(wins, BROADCAST_WINDOWS, F.octet_length("win"), F.octet_length(F.array_join("items", ",")), F.lit(50))
    near = near.join(F.broadcast(wins) if few else wins, "win")
    near = spool(near.groupBy("doc_id", "th", "at").agg(F.max("len").alias("len"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items")), "hits")

    # 3. union of the occurrences, and the items, of each document
    doc = Window.partitionBy("doc_id", "th").orderBy("at")
    reach = F.max(F.col("at") + F.col("len")).over(doc.rowsBetween(Window.unboundedPreceding, -1))
    runs = near.select("doc_id", "th", "at", "len", F.when(reach >= F.col("at"), 0).otherwise(1).alias("new"))
    runs = runs.select("doc_id", "th", "at", "len", F.sum("new").over(doc).alias("run"))
    runs = runs.groupBy("doc_id", "th", "run").agg(F.min("at").alias("at"), F.max(F.col("at") + F.col("len")).alias("end"))
    spans = runs.groupBy("doc_id", "th").agg(F.sum(F.col("end") - F.col("at")).alias("n_hit"), F.array_sort(F.collect_list(F.struct("at", (F.col("end") - F.col("at")).alias("len")))).alias("spans"))
    items = near.select("doc_id", "th", F.explode_outer("items").alias("item")).groupBy("doc_id", "th").agg(F.array_sort(F.collect_set("item")).alias("items"))
    hit = spans.alias("s").join(items.alias("i"), F.col("s.doc_id").eqNullSafe(F.col("i.doc_id")) & (F.col("s.th") == F.col("i.th"))).select("s.doc_id", "s.th", "n_hit", "spans", "items")
    out = rows.alias("r").join(hit.alias("h"), F.col("r.doc_id").eqNullSafe(F.col("h.doc_id")) & (F.col("r.th") == F.col("h.th")), "left")
    return out.select("r.doc_id", "r.th", "r.n_words", F.coalesce("h.n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("h.items", F.array().cast("array<string>")).alias("items"), F.coalesce("h.spans", F.array().cast("array<struct<at: int, len: int>>")).alias("spans"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose text holds a window of a benchmark item; all columns stay.

    Rows are judged one by one, by id and text: a row that shares its id (or
    has none) goes only for its own text.  Either table may be empty.
    """
    key, text = unused(docs, "id"), unused(docs, "hash")
    gone = with_hits(docs, benchmark, 10, 5, id_col, text_col, "item_id", "text").filter("n_hit > 0").select(F.col("doc_id").alias(key), F.col("th").alias(text)).distinct()
    return docs.join(gone, F.col(id_col).eqNullSafe(gone[key]) & (F.xxhash64(text_or_empty(text_col)) == gone[text]), "left_anti")


def op4_decontaminate(spark, sf_dir: str) -> DataFrame:
    out = decontaminate(spread(spark.read.parquet(f"{sf_dir}/documents.parquet")), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') AS win
  FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS t(i) WHERE len(w) > 0
), dw AS (
  SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS win
  FROM d, (SELECT DISTINCT n FROM bw), unnest(range(1, len(w) - n + 2)) AS t(i)
), hit AS (
  SELECT doc_id, item_id, i, dw.n AS n FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n
), covered AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, i, n FROM hit), unnest(range(i, i + n)) AS t(p) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS all_items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY doc_id
)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(all_items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""
