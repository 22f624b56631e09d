"""Transcripts of sessions: files of JSON lines, read from their ends."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import turn_text


def located(uri: str) -> tuple[fs.FileSystem, str]:
    """Arrow's file system of a file, and its path there."""
    return fs.FileSystem.from_uri("file://" + uri[5:] if uri.startswith("file:/") and not uri.startswith("file://") else uri)


def ends(spark: SparkSession, path: str, budget: int) -> DataFrame:
    """(file, raw, cut): the last ``budget`` bytes of each file below a path, and whether that leaves some out.

    Spark lists the files, the tasks read a range of bytes from the end of each:
    a file of any length costs its last bytes.  A file that is gone by then
    gives none.  Stores that Arrow does not open are read whole by Spark.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    first = listed.select("path").first()
    try:
        located(first.path if first else "file:/tmp")
    except (pa.ArrowInvalid, OSError):
        whole = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("file"), F.encode("value", "UTF-8").alias("raw"))
        cut = F.octet_length("raw") > budget
        return whole.select("file", F.when(cut, F.substring("raw", -budget, budget)).otherwise(F.col("raw")).alias("raw"), cut.alias("cut"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, uri in enumerate(batch.column("path").to_pylist()):
                files, name = located(uri)
                try:
                    with files.open_input_file(name) as f:
                        start = max(0, f.size() - budget)
                        raw = f.read_at(f.size() - start, start)
                except FileNotFoundError:
                    raw, start = b"", 0
                yield pa.RecordBatch.from_arrays([batch.column("path").slice(i, 1), pa.array([raw], pa.binary()), pa.array([start > 0])], ["file", "raw", "cut"])

    return listed.select("path").mapInArrow(run, "file string, raw binary, cut boolean")


def tails(spark: SparkSession, path: str, most: int) -> DataFrame:
    """(file, tail): the last ``most`` characters of what user and assistant said, of each file below a path.

    Only the last ``12 * most`` bytes of a file are read; where that cuts a
    line, the cut line is left out.  Lines of other kinds and broken ones are
    passed over.  A file without any gives an empty tail.
    """
    files = ends(spark, path, 12 * most)
    lines = F.split(F.make_valid_utf8(F.col("raw").cast("string")), "\n")  # the cut may lie inside a character
    lines = F.when(F.col("cut"), F.slice(lines, F.lit(2), F.size(lines))).otherwise(lines)
    rows = files.select("file", F.posexplode(lines).alias("pos", "line")).select("file", "pos", turn_text(F.col("line")).alias("said"))
    whole = rows.groupBy("file").agg(F.array_sort(F.collect_list(F.when(F.col("said").isNotNull(), F.struct("pos", "said")))).alias("x"))
    return whole.select("file", F.expr(f"right(array_join(x.said, '\n'), {int(most)})").alias("tail"))
