"""Fill-in-middle against plain slices, and back."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from recollect.llm import fill_middle as fm


def plain(doc_id, text, rate=100, spm=50, seed=7):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return n, "plain", text, None, None
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < spm:
        return n, "spm", f"<S>{s}<P>{p}<M>{m}", len(p), len(m)
    return n, "psm", f"<P>{p}<S>{s}<M>{m}", len(p), len(m)


TEXTS = [
    "one\ntwo\nthree\n", "no end", "\n", "\n\n\n", "", None, "<P>marked\nx", "a <S> b", "<M>", "é\nü 日本\n𝔘𝔫𝔦\n", "a\r\nb\r\n", "<\nS>\nP>\n<", "x" * 300_000 + "\n" + "y" * 10, "line\n" * 20_000, " \t\n \n", "<P\n>S>\n",
]


def frame(spark, rows):
    rows = [(i, t, "f", 1, "o", 2, 3) for i, t in rows]
    return spark.createDataFrame(rows, "doc_id long, text string, form string, n int, output string, low int, k1 int").repartition(3)


def check(out, rows, **more):
    got = sorted(((r.doc_id, r.text, (r["n_"], r["form_"], r["output_"], r.prefix_chars, r.middle_chars)) for r in out.collect()), key=str)
    assert got == sorted(((i, t, plain(i, t, **more)) for i, t in rows), key=str)


@pytest.mark.parametrize("rate, spm, seed", [(100, 50, 7), (60, 20, 1)])
def test_equals_plain_slices(spark, rate, spm, seed):
    rows = [(i, t) for k, t in enumerate(TEXTS) for i in range(k, 160, len(TEXTS))]
    check(fm.fill_in_middle(frame(spark, rows), rate, spm, seed), rows, rate=rate, spm=spm, seed=seed)


def test_text_comes_back(spark):
    rows = [(i, t) for k, t in enumerate(TEXTS) for i in range(k, 320, len(TEXTS))]
    out = fm.fill_in_middle(frame(spark, rows)).select("text", fm.restored(F.col("output_"), F.col("form_")).alias("back"))
    assert all((r.text or "") == r.back for r in out.collect())


def test_repeated_and_null_ids(spark):
    rows = [(1, "a\nb\nc"), (1, "a\nb\nc"), (1, "d\ne\n"), (None, "a\nb"), (None, None), (None, "a\nb"), (2, None), (2, None)]
    check(fm.fill_in_middle(frame(spark, rows)), rows)


def test_sums_over_stretches(spark, monkeypatch):
    monkeypatch.setattr(fm, "STRETCH", 3)
    rows = [(i, "".join(f"line {k} of {i}\n" for k in range(i))) for i in range(40)]
    check(fm.fill_in_middle(frame(spark, rows)), rows)


def test_empty_table(spark):
    out = fm.fill_in_middle(frame(spark, [(1, "x")]).limit(0))
    assert out.count() == 0 and "output_" in out.columns
