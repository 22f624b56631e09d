"""Secret scans in DataFrame functions: three fixed patterns, and character models.

The models are first-order Markov chains over characters, one of random
strings (values that the fixed patterns find, and strings drawn from several
alphabets, which those values may lack) and one of ordinary identifiers (the
words around them, some as in paths, hyphened names and constants).  A token is reported when its log-likelihood ratio
for each character is above a threshold.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import some_rows, spool, spread, text_or_empty, unspool

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
#: Candidates of the character models: long tokens of the characters that keys are made of.
TOKEN = r"[A-Za-z0-9+/_-]{20,}"
#: Ordinary identifiers: letters and inner underscores, no digits.
IDENTIFIER = r"\b[A-Za-z][A-Za-z_]{5,}\b"
#: Order of kinds at one start.
KINDS = ["assign", "access", "hex", "markov"]
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
CLASSES = len(ALPHABET) + 1
#: Alphabets that keys are written in; the random model learns from strings drawn from each.
LETTERS, DIGITS = ALPHABET[:52], ALPHABET[52:62]
DRAWN = [LETTERS + DIGITS, LETTERS + DIGITS + "+/", LETTERS[:26] + DIGITS, DIGITS + "abcdef"]
#: Matches of a text that are summed at a time.
STRETCH = 500
SPANS = "array<struct<start: bigint, end: bigint, kind: string, value: string>>"


def matches(text: str, pattern: str, kind: str, value_group: int | None = None, least: int = 1) -> Column:
    """Leftmost, non-overlapping matches as (start, end, kind, value), in code points.

    Spark has no function for positions, so they are summed from the pieces
    between the matches.  Matches whose value is shorter than ``least`` are
    dropped after the scan.
    """
    p = F.lit(pattern)
    found = F.regexp_extract_all(F.col(text), p, F.lit(0))
    values = F.regexp_extract_all(F.col(text), p, F.lit(value_group or 0))
    gaps = F.split(F.col(text), pattern, -1)
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(SPANS).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        at = acc["at"] + F.length(x["gap"])
        end = at + F.length(x["m"])
        one = F.array(F.struct(at.alias("start"), end.alias("end"), F.lit(kind).alias("kind"), x["v"].alias("value")))
        return F.struct(end.alias("at"), F.when(F.length(x["v"]) >= least, F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    def shifted(s: Column, by: Column) -> Column:
        return F.struct((s["start"] + by).alias("start"), (s["end"] + by).alias("end"), s["kind"].alias("kind"), s["value"].alias("value"))

    def onto(acc: Column, x: Column) -> Column:
        moved = F.transform(x["out"], lambda s: shifted(s, acc["at"]))
        return F.struct((acc["at"] + x["at"]).alias("at"), F.concat(acc["outs"], F.array(moved)).alias("outs"))

    # an array that grows is copied each time, so matches are summed in stretches, and the stretches after one another
    zipped = F.arrays_zip(F.slice(gaps, F.lit(1), F.size(found)).alias("gap"), found.alias("m"), values.alias("v"))
    stretches = F.transform(F.sequence(F.lit(0), F.floor((F.size(found) - 1) / STRETCH).cast("int")), lambda i: F.aggregate(F.slice(zipped, i * STRETCH + 1, F.lit(STRETCH)), start, step))
    none = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(f"array<{SPANS}>").alias("outs"))
    spans = F.aggregate(stretches, none, onto, lambda acc: F.flatten(acc["outs"]))
    return F.when(F.col(text).rlike(pattern), spans).otherwise(F.array().cast(SPANS))


def base_spans(text: str) -> Column:
    return F.concat(matches(text, ASSIGN, "assign", 2, 8), matches(text, ACCESS, "access"), matches(text, HEX, "hex"))


def pairs_of(value: str) -> Column:
    """Positions in a table of all ordered pairs of character classes; other characters share the class 0."""
    return F.expr(f"transform(sequence(1, length({value}) - 1), i -> instr('{ALPHABET}', substring({value}, i, 1)) * {CLASSES} + instr('{ALPHABET}', substring({value}, i + 1, 1)))")


def train(labelled: DataFrame, smooth: float = 0.5, backoff: float = 30.0) -> list[float]:
    """Log-likelihood ratios of all character pairs from (value string, label int); label 1 is a random string.

    A character follows another with its share among the pairs seen, drawn to
    its share among all characters by ``backoff`` pairs, so pairs that the
    samples happen to lack tell little.  Counts are summed on the executors; at
    most two times the number of pairs come to the driver.
    """
    counted = labelled.filter("length(value) > 1").select("label", F.explode(pairs_of("value")).alias("pair")).groupBy("label", "pair").count().collect()
    n = {(r.label, r.pair): r["count"] for r in counted}
    logs = []
    for label in (0, 1):
        table = [[n.get((label, a * CLASSES + b), 0) for b in range(CLASSES)] for a in range(CLASSES)]
        single = [sum(row[b] for row in table) + smooth for b in range(CLASSES)]
        whole = sum(single)
        logs.append([math.log((x + backoff * s / whole) / (sum(row) + backoff)) for row in table for x, s in zip(row, single)])
    return [random - plain for plain, random in zip(*logs)]


def random_strings(spark, n: int) -> DataFrame:
    """``n`` strings of each alphabet of ``DRAWN``, of 20 to 64 characters; the same in every run."""
    one = "substring(letters, pmod(xxhash64(id, kind, i), length(letters)) + 1, 1)"
    kinds = F.posexplode(F.array(*map(F.lit, DRAWN))).alias("kind", "letters")
    return spark.range(n).select("id", kinds).selectExpr(f"array_join(transform(sequence(1, 20 + pmod(id, 45)), i -> {one}), '') AS value")


def labelled_samples(spans: DataFrame, docs: DataFrame, sample: int) -> DataFrame:
    """Samples of both labels, at most ``sample`` values of each source.

    1 for what the fixed patterns found and for strings drawn from each
    alphabet, 0 for identifiers of ``sample / 20`` documents.  One identifier
    in 20 stands between slashes, one between hyphens and one in capitals: the
    joints of names are no sign of a key.
    """
    secret = spans.select("value", F.lit(1).alias("label"))
    drawn = random_strings(docs.sparkSession, sample).select("value", F.lit(1).alias("label"))
    some = some_rows(docs, sample // 20, "doc_id", "text").withColumnRenamed("id", "doc_id")
    plain = some.select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(IDENTIFIER), F.lit(0))).alias("pos", "value"))
    plain = plain.selectExpr("value", "pmod(xxhash64(doc_id, pos), 20) AS form", "0 AS label")
    plain, form = plain.orderBy(F.xxhash64("value"), "value", "form").limit(sample), F.col("form")
    name = F.when(form == 0, F.concat(F.lit("/"), "value", F.lit("/"))).when(form == 1, F.concat(F.lit("-"), "value", F.lit("-"))).when(form == 2, F.upper("value")).otherwise(F.col("value"))
    return secret.orderBy(F.xxhash64("value"), "value").limit(sample).union(drawn).union(plain.select(name.alias("value"), "label"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = 20_000, threshold: float = 0.5) -> DataFrame:
    """One row per row of ``docs``: doc_id, base and added (arrays of start, end, kind, value).

    Null texts count as empty, repeated rows are scanned each, and an empty
    table gives no rows.  The models are trained on at most ``sample`` values
    of each source; where there is no identifier no span is added.
    Candidates of the models are tokens of 20 characters or more with a digit
    and a letter that no base span touches.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    found = docs.select("doc_id", base_spans("text").alias("base"), matches("text", TOKEN, "markov").alias("tokens"))
    free = F.filter("tokens", lambda t: ~F.exists("base", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))
    found = spool(found.select("doc_id", "base", free.alias("tokens")), "spans")
    values = spool(labelled_samples(found.select(F.explode("base").alias("s")).select("s.value"), docs, sample), "samples")
    ratios = train(values)
    trained = values.select("label").distinct().count() == 2
    unspool(values)
    table = "array(" + ",".join(f"{x:.4f}D" for x in ratios) + ")"
    mean = f"aggregate(sequence(1, length(t.value) - 1), 0D, (a, i) -> a + element_at({table}, instr('{ALPHABET}', substring(t.value, i, 1)) * {CLASSES} + instr('{ALPHABET}', substring(t.value, i + 1, 1)) + 1)) / (length(t.value) - 1)"
    if not trained:
        return found.select("doc_id", "base", F.array().cast(SPANS).alias("added"))
    added = F.expr(f"filter(tokens, t -> t.value RLIKE '[0-9]' AND t.value RLIKE '[A-Za-z]' AND {mean} > {threshold})")
    return found.select("doc_id", "base", F.when(F.size("tokens") > 0, added).otherwise(F.array().cast(SPANS)).alias("added"))


def listed(spans: Column) -> Column:
    """kind:start:end by start, then by the order of kinds, joined by commas."""
    order = F.array(*(F.lit(k) for k in KINDS))
    keyed = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("a"), F.array_position(order, s["kind"]).alias("k"), s["end"].alias("e"), s["kind"].alias("kind"))))
    return F.array_join(F.transform(keyed, lambda s: F.concat_ws(":", s["kind"], s["a"].cast("string"), s["e"].cast("string"))), ",")


def op9_secret_scan(spark, sf_dir: str) -> DataFrame:
    out = scan(spread(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return out.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.concat("base", "added")).alias("spans"))
