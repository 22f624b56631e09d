"""Token files and packing: exact round trips against the tokenizers library."""

import zlib

import brute
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from recollect.llm import tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")
ROWS = brute.corpus(60) + [(900, "<|endoftext|> and   more   space"), (901, "x\n\n y"), (902, " lead  ")]


def ids_of(end):
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return {i: t.encode(x or "", add_special_tokens=False).ids + [end] for i, x in ROWS}


@pytest.fixture(scope="module")
def docs(spark):
    return brute.frame(spark, ROWS).cache()


def test_files(spark, docs, tmp_path):
    tokens.write_tokens(docs, f"{tmp_path}/ids", PATH)
    rows = tokens.with_starts(tokens.read_tokens(spark, f"{tmp_path}/ids")).collect()
    wanted, start = ids_of(2), 0
    assert {r.doc_id: r["ids"] for r in rows} == wanted
    for r in sorted(rows, key=lambda r: (r.part, r.row)):
        assert r.start == start and r.n_tokens == len(wanted[r.doc_id])
        start += r.n_tokens
    assert [r.doc_id for r in sorted(rows, key=lambda r: r.start)] == sorted(wanted)


def test_metadata_is_read_without_ids(spark, docs, tmp_path):
    tokens.write_tokens(docs, f"{tmp_path}/ids", PATH)
    plan = tokens.read_tokens(spark, f"{tmp_path}/ids").select("doc_id", "n_tokens")._jdf.queryExecution().executedPlan().toString()
    assert "ids" not in plan.split("ReadSchema:")[1]


def test_packing(docs):
    rows = tokens.pack(docs, PATH).collect()
    wanted = ids_of(0)
    for i, whole in wanted.items():
        own = sorted((r.start, r["ids"]) for r in rows if r.doc_id == i)
        assert [x for _, ids in own for x in ids] == whole
    by_sequence = {}
    for r in rows:
        assert r.doc_tokens == len(wanted[r.doc_id]) and r.length == len(r["ids"])
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s, pieces in by_sequence.items():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at == 1024 or s == max(by_sequence)
    assert sorted(by_sequence) == list(range(len(by_sequence)))


def test_crc_of_the_cutting_pass(docs):
    apart = tokens.with_crc(tokens.pack(docs, PATH))
    assert sorted(tokens.pack(docs, PATH, with_ids=False).select(apart.columns).collect()) == sorted(apart.collect())


def test_crc(docs):
    rows = tokens.with_crc(tokens.pack(docs, PATH)).collect()
    wanted = ids_of(0)
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(np.array(wanted[r.doc_id][r.start : r.start + r.length], "<u4").tobytes())


def test_empty_table(spark, docs, tmp_path):
    assert tokens.pack(docs.limit(0), PATH).count() == 0
    tokens.write_tokens(docs.limit(0), f"{tmp_path}/none", PATH)
    assert tokens.read_tokens(spark, f"{tmp_path}/none").count() == 0


def test_repeated_rows_and_null_ids_are_packed_each(spark):
    rows = tokens.pack(brute.frame(spark, [(1, "a b"), (1, "a b"), (None, None)]), PATH).collect()
    assert sorted((r.doc_id or 0, r.length) for r in rows) == [(0, 1), (1, 3), (1, 3)]


def test_added_tokens_in_texts_are_those_tokens(spark, tmp_path):
    import corpus_pipeline

    texts = ["a<|endoftext|>b", "<|endoftext|>", "x <|endoftext|> y  z", "plain words here", "<|endoftext|><|endoftext|> w", "<|endof text|>", "words <|endoftext|", None]
    rows = list(enumerate(texts))
    brute.frame(spark, rows).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    loaded = Tokenizer.from_file(PATH)
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    wanted = {i: loaded.encode(t or "", add_special_tokens=False).ids for i, t in rows}
    assert wanted[0] == [64, 50256, 65]
    got = {r.doc_id: (r.n_tokens, r.ids_crc32) for r in tokens.op2_token_output(spark, str(tmp_path)).collect()}
    assert got == {i: (len(ids) + 1, crc(ids + [2])) for i, ids in wanted.items()}
    for out in (tokens.op8_packing(spark, str(tmp_path)), corpus_pipeline.packed(spark, brute.frame(spark, rows), str(tmp_path))):
        assert {r.doc_id: (r.doc_tokens, r.ids_crc32) for r in out.collect()} == {i: (len(ids) + 1, crc(ids + [0])) for i, ids in wanted.items()}


@pytest.mark.parametrize("added", [True, False])
def test_ids_are_those_of_the_library_on_odd_texts(added, monkeypatch):
    """Joined units, portions and white space of every kind, against whole texts."""
    import random

    import pyarrow as pa

    for name, value in {"JOINED": 7, "BATCH": 3, "PORTION": 200}.items():
        monkeypatch.setattr(tokens, name, value)
    parts = "a b Z don 's 'll ' ll 7 42 . !! , é × ÷ ß 日本 İ я ٣ ½ _ - 😀 ñ ª ⅷ <|endoftext|>".split() + [" ", "  ", "\n", "\t", "\r\n"]
    parts += [chr(x) for x in (0, 0x0B, 0x1C, 0x7F, 0x85, 0xA0, 0x1680, 0x2003, 0x200B, 0x2028, 0x3000, 0x301)]
    rng = random.Random(5)
    library = Tokenizer.from_file(PATH)
    library.encode_special_tokens = not added
    encoder = tokens.Encoder(PATH, added)
    for _ in range(60):
        texts = ["".join(rng.choice(parts) for _ in range(rng.choice([0, 1, 2, 3, 8, 30]))) for _ in range(60)]
        got = [x.tolist() for _, _, ids, counts in encoder.encode(pa.array(texts, pa.string())) for x in np.split(ids, np.cumsum(counts)[:-1])]
        assert got == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_file_format_lets_readers_skip(docs, tmp_path):
    """Footers name delta encoding and page indexes, rows are in order, and a range of ids reads few row groups."""
    import glob

    import pyarrow.parquet as pq

    tokens.write_tokens(docs, f"{tmp_path}/ids", PATH, **{"parquet.block.row.count.limit": "16"})
    groups, with_rows = 0, 0
    for file in sorted(glob.glob(f"{tmp_path}/ids/part-*.parquet")):
        meta = pq.ParquetFile(file).metadata
        for g in range(meta.num_row_groups):
            columns = [meta.row_group(g).column(i) for i in range(meta.num_columns)]
            ids = next(c for c in columns if c.path_in_schema.startswith("ids"))
            assert "DELTA_BINARY_PACKED" in ids.encodings and not ids.has_dictionary_page
            assert all(c.has_offset_index and c.has_column_index for c in columns)
            own = next(c for c in columns if c.path_in_schema == "doc_id").statistics
            groups, with_rows = groups + 1, with_rows + (own.min <= 20 <= own.max)
    assert with_rows == 1 and groups > 1


def test_chosen_documents_are_read_by_a_pushed_filter(spark, docs, tmp_path):
    tokens.write_tokens(docs, f"{tmp_path}/ids", PATH)
    chosen = tokens.read_tokens(spark, f"{tmp_path}/ids", first=10, last=12)
    assert "GreaterThanOrEqual(doc_id,10)" in chosen._jdf.queryExecution().executedPlan().toString()
    wanted = ids_of(2)
    assert {r.doc_id: r["ids"] for r in chosen.collect()} == {i: wanted[i] for i in (10, 11, 12)}
