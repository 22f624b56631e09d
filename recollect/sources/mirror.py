"""Notes as files that follow a store: what is new or changed is written, what went is removed, the index is kept.

Files are written by tasks through Arrow's file systems (local, HDFS, S3 and
what else a URI names), each under its own name and by a rename at the end, so a
task that runs twice leaves what one run does.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import note_name
from ..streaming import replay as store
from .scratch import children, spool, spread, unspool
from .sync import digest, markdown, mirror

INDEX = "_index.md"
#: Names that a task gives on at once, and bytes of a piece of the index that it reads at once.
LISTED, READ = 10_000, 4 << 20


def opened(out: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder and its path there."""
    return fs.FileSystem.from_uri(out) if "://" in out or out.startswith("file:") else (fs.LocalFileSystem(), out)


def write_file(files: fs.FileSystem, path: str, pieces: Iterator[bytes]) -> None:
    """A file, whole or not at all."""
    files.create_dir(posixpath.dirname(path), recursive=True)
    half = f"{path}.{uuid.uuid4().hex[:8]}.tmp"
    with files.open_output_stream(half) as f:
        for piece in pieces:
            f.write(piece)
    files.move(half, path)


def apply_changes(changes: DataFrame, out: str) -> dict[str, int]:
    """Write or remove the files of (path, body, change) below a folder; how many of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = opened(out)
        for batch in batches:
            for path, body, change in zip(*(batch.column(c).to_pylist() for c in ("path", "body", "change"))):
                whole = posixpath.join(root, path)
                if change == "write":
                    write_file(files, whole, iter([body.encode()]))
                elif files.get_file_info(whole).type != fs.FileType.NotFound:
                    files.delete_file(whole)
            yield pa.RecordBatch.from_arrays([batch.column("change")], ["change"])

    done = changes.select("path", "body", "change").mapInArrow(run, "change string")
    return {r.change: r["count"] for r in done.groupBy("change").count().collect()}


def files_below(spark: SparkSession, out: str) -> DataFrame:
    """(path) of the files below a folder: the folders of projects, then those of types are dealt to tasks, and each lists its own."""

    def listed(deep: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            files, root = opened(out)
            for batch in batches:
                for path, is_folder in zip(batch.column("path").to_pylist(), batch.column("is_folder").to_pylist()):
                    if not is_folder:
                        yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([False])], ["path", "is_folder"])
                        continue
                    top = posixpath.join(root, path).rstrip("/")
                    found = files.get_file_info(fs.FileSelector(top, allow_not_found=True, recursive=deep))
                    for k in range(0, len(found), LISTED):
                        some = found[k : k + LISTED]
                        paths = [posixpath.join(path, i.path.removeprefix(top).lstrip("/")) for i in some]
                        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array([i.type == fs.FileType.Directory for i in some])], ["path", "is_folder"])

        return run

    rows = spark.createDataFrame([("", True)], "path string, is_folder boolean")
    for deep in (False, False, True):
        rows = rows.mapInArrow(listed(deep), rows.schema)
        rows = rows if deep else rows.repartition(4 * spark.sparkContext.defaultParallelism)
    return rows.filter("NOT is_folder").select("path")


def index_lines(notes: DataFrame) -> DataFrame:
    """(project, id, line) of the index: a row for each live note, linked by its file's name."""
    link = F.concat(F.lit("[["), note_name(F.col("id"), F.col("title")), F.lit("]]"))
    line = F.concat(F.lit("| "), F.col("id"), F.lit(" | "), link, F.lit(" | "), "type", F.lit(" | "), F.date_format("created_at", "yyyy-MM-dd"), F.lit(" |\n"))
    return notes.filter("deleted_at IS NULL").select("project", "created_at", "id", line.alias("line"))


def write_index(notes: DataFrame, out: str, day: str) -> None:
    """``_index.md``: a section for each project, its notes by their time.  Tasks sort and write pieces of it; it is one file, so one task puts their bytes together."""
    spark = notes.sparkSession
    lines = spool(index_lines(notes), "lines")  # counted, divided and sorted: made once
    totals = lines.groupBy("project").agg(F.count(F.lit(1)).alias("n"))
    whole = totals.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    head = f"# Índice de Memoria\n\n> Exportado: {day} | Total: {whole} observaciones\n\n"
    heads = totals.select("project", F.lit(0).alias("kind"), F.lit(None).cast("timestamp_ntz").alias("created_at"), F.lit(None).cast("bigint").alias("id"), F.concat(F.lit("## "), "project", F.lit(" ("), "n", F.lit(")\n\n| ID | Título | Tipo | Fecha |\n|----|--------|------|-------|\n")).alias("line"))
    ends = totals.select("project", F.lit(2).alias("kind"), F.lit(None).cast("timestamp_ntz").alias("created_at"), F.lit(None).cast("bigint").alias("id"), F.lit("\n").alias("line"))
    rows = heads.unionByName(lines.withColumn("kind", F.lit(1))).unionByName(ends)
    order = ["project", "kind", "created_at", "id"]
    pieces = f"{INDEX}.{uuid.uuid4().hex[:8]}.pieces"

    def sorted_piece(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = opened(out)
        number = TaskContext.get().partitionId()
        write_file(files, posixpath.join(root, pieces, str(number)), ("".join(batch.column("line").to_pylist()).encode() for batch in batches))
        yield pa.RecordBatch.from_arrays([pa.array([number])], ["n"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = opened(out)

        def read() -> Iterator[bytes]:
            yield head.encode()
            for number in numbers:
                with files.open_input_stream(posixpath.join(root, pieces, str(number))) as f:
                    while some := f.read(READ):
                        yield some

        for batch in batches:
            write_file(files, posixpath.join(root, INDEX), read())
            yield batch

    try:
        made = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("line").mapInArrow(sorted_piece, "n bigint")
        numbers = sorted(r.n for r in made.collect())
        spark.range(0, 1, 1, 1).mapInArrow(joined, "id bigint").collect()
    finally:
        files, root = opened(out)
        if files.get_file_info(posixpath.join(root, pieces)).type != fs.FileType.NotFound:
            files.delete_dir(posixpath.join(root, pieces))
    unspool(lines)


def export(notes: DataFrame, out: str, day: str, project: str | None = None) -> None:
    """All live notes, of a project where one is named, as files with an index."""
    live = notes.filter("deleted_at IS NULL")
    live = live.filter(F.col("project") == project) if project else live
    apply_changes(markdown(spread(live)).withColumn("change", F.lit("write")), out)
    write_index(live, out, day)


def follow(spark: SparkSession, folder: str, out: str, day: str) -> dict[str, int]:
    """Bring the files of a folder from the commit of a store that they show to its last one; what was written and removed.

    Of the store only the parts that came since then are looked through for what
    changed.  Which commit the files show is marked after they do, so a call
    that failed is made good by the next.
    """
    marks = f"{folder}/mirrors/{uuid.uuid5(uuid.NAMESPACE_URL, out).hex}"
    shown = sorted(int(m) for m in children(spark, marks) if "_SUCCESS" in children(spark, f"{marks}/{m}"))
    parts = spark.read.schema("part string").json(f"{marks}/{shown[-1]}").collect() if shown else []
    old = [r.part for r in parts]
    number, tables = store.last_commit(spark, folder)
    new = tables.get("observations", [])
    if shown and shown[-1] == number:
        return {}
    after, live = store.parts_of(spark, folder, "observations", new), "deleted_at IS NULL"
    if not old:  # nothing is shown yet
        changes = markdown(spread(after.filter(live))).withColumn("change", F.lit("write"))
    else:
        before, changed = store.parts_of(spark, folder, "observations", old).withColumn("content", digest("content")), after
        if new[: len(old)] == old:  # what a later part has is the newest of its id; else parts were merged
            changed = store.parts_of(spark, folder, "observations", new[len(old) :])
            before = before.join(changed.select("id").distinct(), "id")  # not a semi join, which would move the texts before their digests are made
        changes = mirror(before.filter(live), changed.filter(live), digested=True)
    counts = apply_changes(changes, out)
    if counts or not shown:
        write_index(after, out, day)
    rows = spark.createDataFrame([(p,) for p in new], "part string")
    rows.coalesce(1).write.mode("overwrite").json(f"{marks}/{number}")
    return counts
