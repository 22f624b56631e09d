"""Fill-in-middle transformation by relational units.

The lines of a text are its units.  Their matches are exploded with their
ordinals, windows make running sums of their lengths, each document's two cut
requests are joined to them by unit ordinal, the sums found are aggregated to
the document's offsets, and substrings of the text make the output.

Running sums are made in stretches of units, then over the sums of stretches,
so no task has to sort all lines of a long text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import spool, spread, text_or_empty, unused

#: A line with its end, or what is left.
UNIT = r"[^\n]*\n|[^\n]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Units whose running sum one window makes.
STRETCH = 4096


def draws(seed: int, doc_id: str) -> list[Column]:
    """Four numbers below 2 ** 32 of each document: groups of hex digits of the hash of the seed and its id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` as (id, text) with two hashes of both, the key of a document: rows that repeat share it."""
    out = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    return out.withColumns({"k1": F.xxhash64("text", "id"), "k2": F.xxhash64(F.lit(1), "id", "text")})


def cut_offsets(docs: DataFrame, rate: int, spm: int, seed: int) -> DataFrame:
    """(k1, k2, n, form, low, high): of each document its units, form, and the code points before either cut."""
    lengths = F.transform(F.regexp_extract_all("text", F.lit(UNIT), 0), F.char_length)
    marked = (F.col("text") == "") | F.col("text").contains(PREFIX) | F.col("text").contains(SUFFIX) | F.col("text").contains(MIDDLE)
    per_doc = docs.groupBy("k1", "k2").agg(F.first(F.struct("id", lengths.alias("lengths"), marked.alias("marked"))).alias("d")).select("k1", "k2", "d.*")
    h1, h2, h3, h4 = draws(seed, "id")
    n = F.size("lengths")
    form = F.when(F.col("marked") | (h3 % 100 >= rate), "plain").when(h4 % 100 < spm, "spm").otherwise("psm")
    per_doc = per_doc.select("k1", "k2", "lengths", n.alias("n"), form.alias("form"), (h1 % (n + 1)).cast("int").alias("c1"), (h2 % (n + 1)).cast("int").alias("c2"))
    per_doc = spool(per_doc.withColumns({"a": F.least("c1", "c2"), "b": F.greatest("c1", "c2")}).drop("c1", "c2"), "units")

    # running sums of units, numbered from 1, in stretches
    units = per_doc.filter("form <> 'plain'").select("k1", "k2", F.posexplode("lengths").alias("pos", "length"))
    units = units.select("k1", "k2", (F.col("pos") + 1).alias("unit"), F.floor(F.col("pos") / STRETCH).cast("int").alias("stretch"), F.col("length").cast("long").alias("length"))
    inside = Window.partitionBy("k1", "k2", "stretch").orderBy("unit").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = units.withColumn("inside", F.sum("length").over(inside))
    before = Window.partitionBy("k1", "k2").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    whole = units.groupBy("k1", "k2", "stretch").agg(F.sum("length").alias("length")).withColumn("before", F.coalesce(F.sum("length").over(before), F.lit(0)))

    # the requests, one row each: a cut after unit 0 is at the start, others meet their unit
    asked = per_doc.filter("form <> 'plain'").select("k1", "k2", F.explode(F.array(F.struct(F.lit(0).alias("which"), F.col("a").alias("unit")), F.struct(F.lit(1).alias("which"), F.col("b").alias("unit")))).alias("r"))
    asked = asked.select("k1", "k2", "r.which", "r.unit", F.floor((F.col("r.unit") - 1) / STRETCH).cast("int").alias("stretch")).filter("unit > 0")
    met = asked.join(sums.select("k1", "k2", "stretch", F.col("unit").alias("own"), "inside"), ["k1", "k2", "stretch"]).filter("unit = own")
    met = met.join(whole.select("k1", "k2", "stretch", "before"), ["k1", "k2", "stretch"])
    at = lambda w: F.max(F.when(F.col("which") == w, F.col("before") + F.col("inside")))
    offsets = met.groupBy("k1", "k2").agg(at(0).alias("low"), at(1).alias("high"))
    found = per_doc.select("k1", "k2", "n", "form").join(offsets, ["k1", "k2"], "left")
    return found.select("k1", "k2", "n", "form", F.coalesce("low", F.lit(0)).cast("int").alias("low"), F.coalesce("high", F.lit(0)).cast("int").alias("high"))


def restored(output: Column, form: Column) -> Column:
    """The text that an output of this form was made from."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    part = lambda i: F.get(parts, F.lit(i))
    return F.when(form == "plain", output).when(form == "psm", F.concat(part(1), part(3), part(2))).otherwise(F.concat(part(2), part(3), part(1)))


def fill_in_middle(docs: DataFrame, rate: int = 100, spm: int = 50, seed: int = 7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with n, form, output, prefix_chars and middle_chars (named anew where the table has such columns).

    ``n`` counts the lines of a text; two of their ends are drawn by its id,
    and the text before, between and after them is the prefix, middle and
    suffix.  ``form`` is ``plain`` (the text itself) for empty texts, those that
    hold a mark and ``100 - rate`` in a hundred others; of the rest ``spm`` in a
    hundred put the suffix first.  ``restored`` gives back the text.

    A null text is empty.  A null id draws like an empty one, so such rows are
    cut at places that depend on their lines only.  Rows that repeat an id draw
    alike, each on its own text; rows that repeat both get equal results.  A
    very long text is one row from first to last, but its lines are summed in
    many tasks.  An empty table gives no rows; further columns stay.
    """
    own = keyed(docs, id_col, text_col)
    found = cut_offsets(own, rate, spm, seed)
    name = {c: unused(docs, c) for c in ("n", "form", "output", "prefix_chars", "middle_chars", "k1", "k2", "low", "high", "whole")}
    text = text_or_empty(text_col)
    rows = docs.withColumns({name["k1"]: F.xxhash64(text, id_col), name["k2"]: F.xxhash64(F.lit(1), id_col, text), name["whole"]: text})
    found = found.select(*(F.col(c).alias(name[c]) for c in ("k1", "k2", "n", "form", "low", "high")))
    # texts are shuffled once and not sorted: the offsets of a partition, far smaller, are looked up
    rows = rows.join(found.hint("shuffle_hash"), [name["k1"], name["k2"]])
    text, form, low, high = (F.col(name[c]) for c in ("whole", "form", "low", "high"))
    prefix, middle, suffix = F.substring(text, F.lit(1), low), F.substring(text, low + 1, high - low), F.substring(text, high + 1, F.char_length(text))
    psm = F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)
    spm_form = F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)
    made = {
        name["n"]: F.col(name["n"]).cast("long"),
        name["output"]: F.when(form == "plain", text).when(form == "psm", psm).otherwise(spm_form),
        name["prefix_chars"]: F.when(form != "plain", low.cast("long")),
        name["middle_chars"]: F.when(form != "plain", (high - low).cast("long")),
    }
    return rows.withColumns(made).select(*docs.columns, *(name[c] for c in ("n", "form", "output", "prefix_chars", "middle_chars")))


def op12_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    out = fill_in_middle(spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")))
    back = restored(F.col("output"), F.col("form"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), u AS (
  SELECT *, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS w, list_transform([1, 9, 17, 25], lambda i: CAST('0x' || substr(h, i, 8) AS BIGINT)) AS r FROM d
), c AS (
  SELECT *, len(w) AS n, least(r[1] % (len(w) + 1), r[2] % (len(w) + 1)) AS a, greatest(r[1] % (len(w) + 1), r[2] % (len(w) + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR r[3] % 100 >= 100 THEN 'plain' WHEN r[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM u
), p AS (
  SELECT *, array_to_string(w[1:a], '') AS pre, array_to_string(w[a + 1:b], '') AS mid, array_to_string(w[b + 1:], '') AS suf FROM c
), o AS (
  SELECT *, CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END AS out FROM p
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
  sha256(out) AS output_sha256, sha256(t) AS restored_sha256 FROM o
"""
