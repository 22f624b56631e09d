"""Token ids: encoding, a selective Parquet format for them, and packing into sequences.

Encoding uses a public tokenizer file through the ``tokenizers`` library.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import give_back, list_array, lists, portioned, portions, ragged, scratch, spool, spread, text_or_empty, texts_of

#: Bytes of text whose units are told apart together (one text at least), and bytes of text that are cut or put out at a time.
AT_ONCE, PORTION = 24 << 20, 4 << 20
#: Units that the tokenizer is given as one text, and texts that it is given at a time.
JOINED, BATCH = 1000, 50
#: How a token that starts with a space starts in the vocabulary of a byte-level BPE, and its token of a line end.
SPACE, LINE_END = "\u0120", "\u010a"
#: Classes of bytes: blank, other white space, letter, digit, other sign, apostrophe, never white space, anything.
BLANK, WHITE, LETTER, DIGIT, SIGN, APOSTROPHE, SOLID, ANY = range(8)
CLASS = np.full(256, SOLID, np.uint8)
CLASS[:0x20], CLASS[0x20], CLASS[0x21:0x7F], CLASS[0x7F] = ANY, BLANK, SIGN, ANY
CLASS[[9, 10, 13]], CLASS[0x30:0x3A], CLASS[0x27] = WHITE, DIGIT, APOSTROPHE
CLASS[0x41:0x5B] = CLASS[0x61:0x7B] = LETTER
CLASS[0xC2] = CLASS[0xE1:0xE4] = ANY  # first bytes of all characters beyond ASCII that are white space
#: Neighbours of these classes are never in one piece of the tokenizer's pattern, whatever stands around them.
APART = np.zeros((8, 8), bool)
APART[LETTER:ANY, :LETTER] = APART[WHITE, LETTER:ANY] = True
for _x, _y in ((LETTER, DIGIT), (LETTER, SIGN), (DIGIT, SIGN)):
    APART[_x, _y] = APART[_y, _x] = True
APART[[LETTER, DIGIT], APOSTROPHE] = True


def classes(raw: np.ndarray) -> np.ndarray:
    """The class of each byte of UTF-8; a character's bytes have one class."""
    kinds = CLASS[raw]
    at = np.flatnonzero(raw >= 0x80)
    if len(at):
        byte, own = raw[at], kinds[at]
        follows = raw[np.minimum(at + 1, len(raw) - 1)]
        own[(byte == 0xC3) & (follows != 0x97) & (follows != 0xB7)] = LETTER
        first = np.maximum.accumulate(np.where(byte >= 0xC0, np.arange(len(at)), 0))
        kinds[at] = own[first]
    return kinds


def cuts(raw: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where the units of texts begin: at their starts, and where no piece of the pattern can lie across.

    Of several white characters before a sign the last is a unit of its own or begins the next.
    """
    kinds = classes(raw)
    cut = np.ones(len(raw), bool)
    np.take(APART.ravel(), kinds[:-1] * np.uint8(8) + kinds[1:], out=cut[1:])
    gap = kinds <= WHITE
    last = np.flatnonzero(gap[:-1] & gap[1:]) + 1
    begin = np.zeros(len(raw) + 1, bool)
    begin[starts] = begin[-1] = True
    last = last[~begin[last + 1]]
    after = kinds[last + 1]
    cut[last[(after >= LETTER) & (after <= SOLID)]] = True
    cut |= begin[:-1]
    return np.flatnonzero(cut).astype(np.int32)


class Encoder:
    """Ids of whole texts; each distinct unit of a stretch of text is encoded once.

    Units are parts of a text between places where the tokenizer's pattern
    always begins a new piece, so the ids of a text are those of its units.
    The tokenizer is given many units joined: those that begin with a space,
    as the first token of each begins with it, and those without white space
    on lines of their own.  All others go to it one by one.

    With ``added``, the string of an added token (as ``<|endoftext|>``) is that
    token wherever it stands in a text, as the file's defaults have it; texts
    that hold one go to the tokenizer whole.  Without, special tokens' strings
    are ordinary characters.
    """

    def __init__(self, path: str, added: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not added
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()] if added else []
        vocabulary = self.tokenizer.get_vocab()
        self.top = max(vocabulary.values())
        self.leads, self.ends = np.zeros((2, self.top + 1), bool)
        self.leads[[i for token, i in vocabulary.items() if token.startswith(SPACE)]] = True
        self.ends[vocabulary[LINE_END]] = True

    def whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def each(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of units, and the number of ids of each."""
        ids = [np.array(x, np.int32) for i in range(0, len(units), JOINED) for x in self.whole(units[i : i + JOINED])]
        return np.concatenate([np.zeros(0, np.int32), *ids]), np.fromiter(map(len, ids), np.int64, len(ids))

    def joined(self, units: list[str], line_end: str) -> tuple[np.ndarray, np.ndarray]:
        """The same, of units that all begin with a space, or that have no white space and are joined by ``line_end``."""
        texts = [line_end.join(units[i : i + JOINED]) + line_end for i in range(0, len(units), JOINED)]
        ids = [np.array(x, np.int32) for i in range(0, len(texts), BATCH) for x in self.whole(texts[i : i + BATCH])]
        flat = np.concatenate([np.zeros(0, np.int32), *ids])
        if line_end:
            end = self.ends[flat]
            lengths, flat = np.diff(np.r_[-1, np.flatnonzero(end)]) - 1, flat[~end]
        else:
            lengths = np.diff(np.r_[np.flatnonzero(self.leads[flat]), len(flat)])
        return (flat, lengths) if len(lengths) == len(units) else self.each(units)

    def units(self, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A pool of ids, and where those of each unit begin and how many they are."""
        raw, offsets = texts_of(distinct)
        kinds, first = classes(raw), offsets[:-1]
        loose = np.add.reduceat(((kinds < LETTER) | (kinds == ANY)).astype(np.int32), first)
        led = (kinds[first] == BLANK) & (loose == 1) & (np.diff(offsets) > 1)
        order, pools, lengths = [], [], []
        for chosen, make in ((led, lambda u: self.joined(u, "")), (loose == 0, lambda u: self.joined(u, "\n")), (~led & (loose > 0), self.each)):
            at = np.flatnonzero(chosen)
            ids, n = make(distinct.take(pa.array(at)).cast(pa.string()).to_numpy(zero_copy_only=False).tolist())
            order.append(at)
            pools.append(ids)
            lengths.append(n)
        made = np.concatenate(lengths)
        where = np.concatenate(order)
        starts, counts = np.zeros(len(where), np.int64), np.zeros(len(where), np.int64)
        starts[where], counts[where] = np.cumsum(made) - made, made
        return np.concatenate(pools), starts, counts

    def encode(self, texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(from, to, flat ids, number of ids of each) of one portion of the texts after another."""
        raw, offsets = texts_of(texts)
        slices = portions(offsets, PORTION)
        begins = np.concatenate([np.zeros(0, np.int32), *(offsets[a] + cuts(raw[offsets[a] : offsets[b]], offsets[a:b] - offsets[a]) for a, b in slices if offsets[b] > offsets[a])])
        pool, starts, lengths, number = (np.zeros(0, np.int64),) * 4
        if len(begins):
            found = pa.Array.from_buffers(pa.binary(), len(begins), [None, pa.py_buffer(np.append(begins, np.int32(len(raw)))), pa.py_buffer(raw)]).dictionary_encode()
            pool, starts, lengths = self.units(found.dictionary)
            number = found.indices.to_numpy()
        unit = np.searchsorted(begins, offsets)
        for a, b in slices:
            own = number[unit[a] : unit[b]]
            per = lengths[own]
            counts = np.diff(np.r_[0, np.cumsum(per)][unit[a : b + 1] - unit[a]])
            ids = pool[ragged(starts[own], per)]
            part, whole = texts.slice(a, b - a), np.zeros(b - a, bool)
            for content in self.added:
                whole |= pc.match_substring(part, content).to_numpy(zero_copy_only=False)
            odd = np.flatnonzero(whole)
            if len(odd):
                pieces = np.split(ids, np.cumsum(counts)[:-1])
                for i, own in zip(odd, self.whole(part.take(pa.array(odd)).to_pylist())):
                    pieces[i], counts[i] = np.array(own, np.int32), len(own)
                ids = np.concatenate(pieces)
            yield a, b, ids, counts


@lru_cache(maxsize=1)
def encoder(path: str, added: bool = False) -> Encoder:
    # a task has one core; the library's own threads cost it memory and a quarter more CPU time
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return Encoder(path, added)


def with_end(ids: np.ndarray, counts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The end id after each document's ids, and the new counts."""
    return np.insert(ids, np.cumsum(counts), end_id).astype(np.int32), counts + 1


def encoded(batches: Iterator[pa.RecordBatch], path: str, end_id: int, added: bool = False) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Parts of the batches, with the ids of their column ``text``, in pieces of bounded size."""
    for batch in batches:
        for part in portioned(batch, "text", AT_ONCE):
            for a, b, ids, counts in encoder(path, added).encode(part.column("text")):
                yield part.slice(a, b - a), *with_end(ids, counts, end_id)
    encoder.cache_clear()  # the worker may go on to other work
    give_back()


def crc_of(ids: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    data = memoryview(ids.astype("<u4").tobytes())
    return np.fromiter((zlib.crc32(data[4 * s : 4 * (s + n)]) for s, n in zip(starts.tolist(), lengths.tolist())), np.int64, len(starts))


# --- files of token ids -------------------------------------------------------------------------

#: Small row groups and pages, and the page indexes that this version of the format always has,
#: let a reader of some documents or of the metadata skip the rest.  Ids are delta-encoded (format 2 without dictionary).
FORMAT = {
    "compression": "zstd",
    "parquet.block.size": str(16 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "2000",
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.enable.dictionary": "false",
}


def write_tokens(docs: DataFrame, out: str, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", added: bool = False, **options: str) -> None:
    """Write (doc_id, n_tokens, ids) in ascending doc_id order over the files of ``out``.

    Null texts are empty documents (the end id alone), null ids come first,
    repeated rows are written each, next to one another; other columns are left
    out.  Files are numbered in order, so an empty table writes no rows.
    ``added`` as in ``Encoder``.
    """
    kind = dict(docs.dtypes)[id_col]
    docs = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, ids, counts in encoded(batches, tokenizer, end_id, added):
            offsets = np.r_[0, np.cumsum(counts)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(counts), list_array(ids, offsets, pa.int32())], ["doc_id", "n_tokens", "ids"])

    docs.mapInArrow(run, f"doc_id {kind}, n_tokens bigint, ids array<int>").write.options(**FORMAT | options).parquet(out)


def read_tokens(spark, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """The files of ``write_tokens`` with ``part`` and ``row``, their order; columns that are not selected are not read.

    With ``first`` and ``last``, only documents of these ids and between: files,
    row groups and pages without any are skipped by their statistics.
    """
    part = F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).cast("int")
    rows = spark.read.parquet(path)
    rows = rows if first is None else rows.filter(F.col("doc_id") >= first)
    rows = rows if last is None else rows.filter(F.col("doc_id") <= last)
    return rows.select("*", part.alias("part"), F.col("_metadata.row_index").alias("row"))


def with_starts(rows: DataFrame) -> DataFrame:
    """Adds ``start``: ids of all documents before, by a sum of parts (one small row each) and a sum within each part."""
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = totals.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("before"))
    own = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("row")) - F.col("n_tokens")
    return rows.withColumn("own", own).join(F.broadcast(before), "part").withColumn("start", F.col("before") + F.col("own")).drop("own", "before")


def op2_token_output(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = scratch(spark, "tokens")
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, public_tokenizers.path("byte_bpe_50k.json"), added=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, offsets = lists(batch.column("ids"))
            crc = crc_of(ids, offsets[:-1], np.diff(offsets))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("part"), batch.column("row"), pa.array(np.diff(offsets).astype(np.int64)), pa.array(crc)], ["doc_id", "part", "row", "n_tokens", "ids_crc32"])

    rows = read_tokens(spark, path).select("doc_id", "part", "row", "ids").mapInArrow(run, "doc_id bigint, part int, row bigint, n_tokens bigint, ids_crc32 bigint")
    return with_starts(spool(rows, "crc")).select("doc_id", "start", "n_tokens", "ids_crc32")


# --- packing ------------------------------------------------------------------------------------


def pack(docs: DataFrame, tokenizer: str, length: int = 1024, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True, added: bool = False) -> DataFrame:
    """Concatenate all documents, each with its end id, and cut every ``length`` ids.

    One row per piece: doc_id, start (the document's ids before it), length,
    doc_tokens, sequence_id, offset (in the sequence), padded, ids; without
    ``with_ids`` ids_crc32 in place of ids, which then stay where they are cut.
    Two passes of sums give each document its place: ids are written once with their
    running count in the partition, and the counts of partitions are summed.
    A document that crosses a boundary has a piece on either side.  Only the
    last sequence may be short; ``padded`` is the length that it is filled up
    to, its own where that is a power of two.  Null texts are empty documents
    (one piece, the end id), repeated rows are packed each, an empty table
    gives no rows.  ``added`` as in ``Encoder``.
    """
    kind = dict(docs.dtypes)[id_col]
    docs = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    # ids are kept as bytes between the passes: a column of bytes is copied whole where a list is written id by id
    kept_as = "<u2" if max(encoder(tokenizer, added).top, end_id) < 1 << 16 else "<u4"
    encoder.cache_clear()

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, part = 0, TaskContext.get().partitionId()
        for rows, ids, counts in encoded(batches, tokenizer, end_id, added):
            ends = np.cumsum(counts)
            size = np.dtype(kept_as).itemsize
            data = pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer((np.r_[0, ends] * size).astype(np.int32)), pa.py_buffer(ids.astype(kept_as))])
            arrays = [rows.column("doc_id"), pa.array(np.full(len(counts), part, np.int32)), pa.array(done + ends - counts), pa.array(counts), data]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "part", "own", "n", "ids"])
            done += int(ends[-1])

    rows = spool(docs.mapInArrow(first, f"doc_id {kind}, part int, own bigint, n bigint, ids binary"), "ids")
    totals = rows.groupBy("part").agg(F.sum("n").alias("total"))
    before = totals.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("before"))  # a row for each partition
    all_ids = rows.agg(F.sum("n")).first()[0] or 0
    last, rest = divmod(all_ids, length)
    rows = rows.join(F.broadcast(before), "part").select("doc_id", (F.col("before") + F.col("own")).alias("at"), "n", "ids")

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in portioned(whole, "ids", PORTION)):
            ids = texts_of(batch.column("ids"))[0].view(kept_as).astype(np.int32)
            at, n = batch.column("at").to_numpy(), batch.column("n").to_numpy()
            pieces = (at + n - 1) // length - at // length + 1
            doc = np.repeat(np.arange(len(n)), pieces)
            sequence = ragged(at // length, pieces)
            begin = np.maximum(sequence * length, at[doc])
            size = np.minimum((sequence + 1) * length, (at + n)[doc]) - begin
            padded = np.where((sequence == last) & (rest & (rest - 1) == 0), rest, length)
            cuts = np.r_[0, np.cumsum(size)].astype(np.int32)
            columns = {
                "doc_id": batch.column("doc_id").take(pa.array(doc)), "start": pa.array(begin - at[doc]), "length": pa.array(size), "doc_tokens": pa.array(n[doc]),
                "sequence_id": pa.array(sequence), "offset": pa.array(begin - sequence * length), "padded": pa.array(padded.astype(np.int64)),
            }
            if with_ids:
                columns["ids"] = list_array(ids, cuts, pa.int32())
            else:
                columns["ids_crc32"] = pa.array(crc_of(ids, cuts[:-1], size))
            yield pa.RecordBatch.from_pydict(columns)

    schema = f"doc_id {kind}, start bigint, length bigint, doc_tokens bigint, sequence_id bigint, offset bigint, padded bigint, "
    return rows.mapInArrow(second, schema + ("ids array<int>" if with_ids else "ids_crc32 bigint"))


def with_crc(pieces: DataFrame, ids_col: str = "ids") -> DataFrame:
    """``pieces`` with ``ids_crc32`` in place of the ids."""
    from pyspark.sql.types import LongType, StructType

    schema = StructType([f for f in pieces.schema if f.name != ids_col]).add("ids_crc32", LongType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, offsets = lists(batch.column(ids_col))
            rest = [c for c in batch.schema.names if c != ids_col]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(crc_of(ids, offsets[:-1], np.diff(offsets)))], [*rest, "ids_crc32"])

    return pieces.mapInArrow(run, schema)


def op8_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = pack(spread(spark.read.parquet(f"{sf_dir}/documents.parquet")), public_tokenizers.path("byte_bpe_50k.json"), with_ids=False, added=True)
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "padded")
