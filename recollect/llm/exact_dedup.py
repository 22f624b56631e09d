"""Exact deduplication by a stream with keyed state.

Arrivals (digest, stable identifier, content locator) stream into keyed state
that lives on disk (RocksDB) and never expires.  A key that is met again is a
hit; the full texts of hits are then compared, so equal digests alone never
merge two documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, children, drop_path, fits, has_path, join_counted, move_path, scratch, spool, text_or_empty, unused

STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "300",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}
#: Up to so many hits, they go to every executor (some 70 bytes each beside their ids); above it they are shuffled.
BROADCAST_HITS = 500_000
#: Up to so many files of earlier texts are named one by one.
LISTED_FILES = 10_000


def sha256_digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def keyed_state(docs: DataFrame, folder: str, bytes_per_trigger: int) -> DataFrame:
    """Stream the arrivals of a folder that its state has not seen through it; one row per digest: the row that stays, count."""
    spark = docs.sparkSession.newSession()
    for k, v in STATE.items():
        spark.conf.set(k, v)
    spark.conf.set("spark.sql.shuffle.partitions", docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = spark.read.parquet(f"{folder}/arrivals/*").schema
    stream = spark.readStream.schema(schema).option("maxBytesPerTrigger", str(bytes_per_trigger)).parquet(f"{folder}/arrivals/*")
    state = stream.groupBy("digest").agg(F.max(F.struct("doc_id", "call", "rid", "locator")).alias("keep"), F.count(F.lit(1)).alias("n"))

    def changed(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/changes/batch={number}")

    query = state.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).foreachBatch(changed).start()
    query.awaitTermination()
    session = docs.sparkSession
    out = f"digest binary, keep struct<doc_id: {dict(docs.dtypes)['doc_id']}, call: int, rid: bigint, locator: string>, n bigint, batch int"
    some = has_path(session, f"{folder}/changes")
    changes = session.read.schema(out).option("basePath", f"{folder}/changes").parquet(f"{folder}/changes/*") if some else session.createDataFrame([], out)
    # a count only grows, so the largest is the last
    last = changes.groupBy("digest").agg(F.max(F.struct("n", "keep")).alias("s"))
    return last.select("digest", F.col("s.n").alias("n"), F.col("s.keep.doc_id").alias("keep_id"), F.col("s.keep.call").alias("keep_call"), F.col("s.keep.rid").alias("keep_rid"))


def begun_call(docs: DataFrame, folder: str) -> tuple[int, bool]:
    """The number of this call, and whether it has begun before: a call is known by its rows, whatever their order."""
    spark = docs.sparkSession
    row = F.xxhash64("doc_id", "text").cast("decimal(38,0)")
    one = docs.agg(F.count(F.lit(1)).alias("n"), F.sum(row).alias("a"), F.sum(F.xxhash64(F.lit(1), "text", "doc_id").cast("decimal(38,0)")).alias("b")).first()
    name = f"{one.n}|{one.a}|{one.b}"
    calls = sorted(int(c) for c in children(spark, f"{folder}/calls"))
    if calls and "done" not in children(spark, f"{folder}/calls/{calls[-1]:06d}"):
        call = calls[-1]
        known = spark.read.schema("name string").json(f"{folder}/calls/{call:06d}/name").first()
        if known is not None and known.name != name:
            raise ValueError("the call before this one failed: repeat it first")
    else:
        call = calls[-1] + 1 if calls else 0
    spark.createDataFrame([(name,)], "name string").coalesce(1).write.mode("overwrite").json(f"{folder}/calls/{call:06d}/name")
    return call, has_path(spark, f"{folder}/arrivals/{call:06d}")


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    digest: Callable[[Column], Column] = sha256_digest,
    bytes_per_trigger: int = 4 << 30,
    state: str | None = None,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, digest.

    Texts are equal when identical after lower-casing A-Z.  Of equal texts the
    row with the largest id stays; among repeated rows of that id exactly one
    does.  Null texts count as empty, a null id is below every other, other
    columns are ignored, and an empty table gives no rows.  A hot text costs no
    more than others: state and the comparison of bytes are pre-aggregated
    before their shuffles, and rows of a hot text are joined where they are.

    With ``state``, a folder that all executors share, the keyed state stays
    there without end: each call is compared with all calls before it, and its
    rows say how things stand after it (a row that stayed may be replaced by a
    larger id of a later call).  The folder then keeps the texts too, for the
    comparison of bytes; the locator of an arrival is their file.  A call that
    failed is made good by the same call again, which goes on where it stopped
    and counts each row once; another call before that raises ``ValueError``.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    norm = ascii_lower(F.col("text"))
    folder = state or scratch(spark, "dedup")
    call, begun = begun_call(docs, folder) if state else (0, False)
    if not begun:
        arrived = docs.select("doc_id", F.lit(call).alias("call"), F.monotonically_increasing_id().alias("rid"), digest(norm).alias("digest"), *([norm.alias("norm")] if state else []))
        if state:
            arrived.write.mode("overwrite").parquet(f"{folder}/content/call={call}")
            arrived = spark.read.parquet(f"{folder}/content/call={call}").drop("norm")
        arrived = arrived.withColumn("locator", F.input_file_name())
        # all of a call's arrivals are there or none
        arrived.write.mode("overwrite").parquet(f"{folder}/coming")
        move_path(spark, f"{folder}/coming", f"{folder}/arrivals/{call:06d}")
    everything = spark.read.parquet(f"{folder}/arrivals/*")
    groups = keyed_state(docs, folder, bytes_per_trigger)
    if state:
        spark.range(1).write.mode("overwrite").parquet(f"{folder}/calls/{call:06d}/done")
    else:
        drop_path(spark, f"{folder}/checkpoint")
    arrivals, total = everything.filter(F.col("call") == call), everything.count()

    # full bytes of every hit: the texts of a digest are one if the smallest and the largest are equal
    stays = (F.col("rid") == F.col("keep_rid")) & (F.col("call") == F.col("keep_call"))
    joined = join_counted(arrivals, groups, ["digest"], total)
    hits = joined.filter("n > 1").groupBy("doc_id", "digest").agg(F.lit(True).alias("own"))
    small = fits(hits, BROADCAST_HITS)
    side = (F.broadcast(hits) if small else hits).alias("h")
    full = docs.alias("d").join(side, F.col("d.doc_id").eqNullSafe(F.col("h.doc_id"))).select("d.doc_id", "h.digest", norm.alias("norm"), F.lit(True).alias("own"))
    full = full.filter(digest(F.col("norm")) == F.col("digest"))
    if call:
        old = everything.filter(F.col("call") < call).join(hits.select("digest").distinct(), "digest", "left_semi")
        files = [r.locator for r in old.select("locator").distinct().limit(LISTED_FILES + 1).collect()]
        if files:
            # the files that the locators name; where these are too many to list, all texts of the calls before
            paths = files if len(files) <= LISTED_FILES else [f"{folder}/content/call={c}" for c in range(call)]
            texts = spark.read.option("basePath", f"{folder}/content").parquet(*paths).select("call", "rid", "norm")
            full = full.unionByName(old.join(texts, ["call", "rid"]).select("doc_id", "digest", "norm", F.lit(False).alias("own")))
    differing = full.groupBy("digest").agg(F.min("norm").alias("a"), F.max("norm").alias("b")).filter("a <> b").select("digest")
    out = joined.select("doc_id", "keep_id", F.col("n").alias("group_size"), stays.alias("kept"), "digest")
    if differing.isEmpty():
        return out
    # equal digests, different texts: those digests are grouped by the texts themselves
    apart = full.join(differing, "digest", "left_semi")
    named = apart.groupBy("digest", "norm").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    again = apart.filter("own").select("doc_id", "digest", "norm").join(named, ["digest", "norm"]).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "digest")
    return out.join(differing, "digest", "left_anti").select(again.columns).union(again)


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose text another row keeps; all columns stay.

    Of rows that repeat both the id and the text that stay, one stays (any of
    them where other columns differ); a null id is an id like others here.  An
    empty table gives no rows.
    """
    key, text = unused(docs, "id"), unused(docs, "digest")
    found = exact_dedup(docs, id_col, text_col).groupBy(F.col("doc_id").alias(key), F.col("digest").alias(text)).agg(F.max("kept").alias("stays"), F.count(F.lit(1)).alias("n"))
    found = spool(found.filter("not stays OR n > 1"), "copies")
    own = docs.withColumn(text, sha256_digest(ascii_lower(text_or_empty(text_col))))
    same = F.col(id_col).eqNullSafe(found[key]) & (own[text] == found[text])
    rest = own.join(found.select(key, text), same, "left_anti").drop(text)
    repeated = found.filter("stays")
    if repeated.isEmpty():
        return rest
    rank = unused(docs, "rank")
    again = own.join(repeated.select(key, text), F.col(id_col).eqNullSafe(repeated[key]) & (own[text] == repeated[text]), "left_semi")
    one = again.withColumn(rank, F.row_number().over(Window.partitionBy(id_col, text).orderBy(F.lit(0)))).filter(F.col(rank) == 1)
    return rest.unionByName(one.drop(text, rank))


def op3_exact_dedup(spark, sf_dir: str) -> DataFrame:
    out = exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


SQL = """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
  FROM documents
)
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY norm) AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY norm) AS kept,
       sha256(norm) AS text_sha256
FROM d
"""
