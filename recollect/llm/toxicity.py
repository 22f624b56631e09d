"""Toxicity by a factorization machine over hashed terms.

score = sigmoid(w0 + sum w_i + sum over pairs <v_i, v_j>) over the distinct
terms of a text, so a pair of terms can weigh more than its parts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lists, spread, text_or_empty

BUCKETS = 1 << 20


def terms_of(text: Column) -> Column:
    """Hashes of the distinct terms: runs of letters and digits, in lower case."""
    return F.array_distinct(F.transform(F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), ""), lambda w: F.pmod(F.xxhash64(w), F.lit(BUCKETS)).cast("int")))


class Machine:
    """A factorization machine with sorted term numbers, linear weights and factors."""

    def __init__(self, terms: np.ndarray, w0: float, w: np.ndarray, v: np.ndarray):
        self.terms, self.w0, self.w, self.v = terms, w0, w, v

    def margins(self, flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n = len(offsets) - 1
        if not len(self.terms):
            return np.full(n, self.w0)
        at = np.minimum(np.searchsorted(self.terms, flat), len(self.terms) - 1)
        known = self.terms[at] == flat
        doc, at = np.repeat(np.arange(n), np.diff(offsets))[known], at[known]
        out = self.w0 + np.bincount(doc, self.w[at], n)
        for f in range(self.v.shape[1]):
            x = self.v[at, f]
            out += 0.5 * (np.bincount(doc, x, n) ** 2 - np.bincount(doc, x * x, n))
        return out

    def scores(self, flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(flat, offsets), -40, 40)))


def evidence_of(k: np.ndarray, n: np.ndarray, share: float) -> np.ndarray:
    """Log-likelihood statistic of k labels among n rows, where ``share`` of all rows have the label."""
    part = lambda x, p: np.where(x > 0, x * np.log(np.maximum(x, 1e-9) / np.maximum(n * p, 1e-9)), 0)
    return 2 * (part(k, share) + part(n - k, 1 - share))


def telling_pairs(at: np.ndarray, lengths: np.ndarray, y: np.ndarray, terms: int, share: float, least: float) -> np.ndarray:
    """Which of so many terms are in a pair with evidence of ``least`` or more, counted over all rows by products of blocks."""
    both, right = np.zeros((2, terms, terms), np.float32)
    rows = np.repeat(np.arange(len(lengths)), lengths)
    for a in range(0, len(lengths), 1000):
        own = (rows >= a) & (rows < a + 1000)
        x = np.zeros((min(1000, len(lengths) - a), terms), np.float32)
        x[rows[own] - a, at[own]] = 1
        both += x.T @ x
        right += (x * y[a : a + 1000, None].astype(np.float32)).T @ x
    told = evidence_of(right.astype(float), both.astype(float), share) >= least
    np.fill_diagonal(told, False)
    return told.any(axis=1)


def fit(flat: np.ndarray, offsets: np.ndarray, y: np.ndarray, factors: int = 4, epochs: int = 20, batch: int = 64, rate: float = 0.1, sparse: float = 2e-3, decay: float = 1e-2, evidence: float = 15.0, common: float = 0.05, pair_evidence: float = 30.0, pair_terms: int = 2000, seed: int = 7) -> Machine:
    """Stochastic gradient steps of adapted size on the logistic loss.

    Terms take part whose own log-likelihood statistic against the label is
    ``evidence`` or more, those in a share of ``common`` of the documents or
    more, which may tell something in a pair, and of the ``pair_terms`` most
    frequent others those in a pair whose statistic is ``pair_evidence`` or
    more.  Linear weights are drawn to 0 by ``sparse``, and factors shrink by
    ``decay``.
    """
    share = np.clip(y.mean() if len(y) else 0.0, 1e-3, 1 - 1e-3)
    seen, own, n = np.unique(flat, return_inverse=True, return_counts=True)
    k = np.bincount(own, np.repeat(y, np.diff(offsets)), len(seen))
    chosen = (evidence_of(k, n, share) >= evidence) | (n >= common * max(len(y), 100))
    others = np.flatnonzero(~chosen & (n >= 10))
    others = np.sort(others[np.argsort(-n[others], kind="stable")][:pair_terms])
    if len(others):
        place = np.minimum(np.searchsorted(others, own), len(others) - 1)
        is_other = others[place] == own
        per_row = np.diff(np.r_[0, np.cumsum(is_other)][offsets])
        chosen[others[telling_pairs(place[is_other], per_row, y, len(others), share, pair_evidence)]] = True
    terms = seen[chosen]
    machine = Machine(terms, float(np.log(share / (1 - share))), np.zeros(len(terms)), np.random.default_rng(seed).normal(0, 0.01, (len(terms), factors)))
    if not len(terms) or share in (1e-3, 1 - 1e-3):
        machine.v[:] = 0
        return machine
    at = np.minimum(np.searchsorted(terms, flat), len(terms) - 1)
    known = terms[at] == flat
    kept = np.r_[0, np.cumsum(known)][offsets]
    at, lengths = at[known], np.diff(kept)
    g0, gw, gv = 1e-8, np.full(len(terms), 1e-8), np.full((len(terms), factors), 1e-8)
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for rows in np.array_split(order := rng.permutation(len(y)), max(1, len(order) // batch)):
            doc = np.repeat(np.arange(len(rows)), lengths[rows])
            col = at[np.concatenate([np.arange(kept[r], kept[r + 1]) for r in rows])] if len(doc) else np.zeros(0, int)
            x = machine.v[col]
            total = np.stack([np.bincount(doc, x[:, f], len(rows)) for f in range(factors)], axis=1)
            squares = np.bincount(doc, (x * x).sum(axis=1), len(rows))
            margin = machine.w0 + np.bincount(doc, machine.w[col], len(rows)) + 0.5 * ((total**2).sum(axis=1) - squares)
            error = (1 / (1 + np.exp(-np.clip(margin, -40, 40))) - y[rows]) / len(rows)
            d0 = error.sum()
            g0 += d0 * d0
            machine.w0 -= rate * d0 / np.sqrt(g0)
            own, inverse = np.unique(col, return_inverse=True)
            dw = np.bincount(inverse, error[doc], len(own))
            gw[own] += dw * dw
            step = rate / np.sqrt(gw[own])
            w = machine.w[own] - step * dw
            machine.w[own] = np.sign(w) * np.maximum(np.abs(w) - step * sparse, 0)
            dv = np.stack([np.bincount(inverse, error[doc] * (total[doc, f] - x[:, f]), len(own)) for f in range(factors)], axis=1)
            gv[own] += dv * dv
            vstep = rate / np.sqrt(gv[own])
            machine.v[own] = (machine.v[own] - vstep * dv) / (1 + vstep * decay)
    used = (machine.w != 0) | (np.abs(machine.v).max(axis=1) > 0.05)
    return Machine(terms[used], machine.w0, machine.w[used], machine.v[used])


def train(labelled: DataFrame) -> Machine:
    """A machine from (text, label) of a bounded number of rows, fitted in one task; its weights come to the driver."""
    rows = labelled.select(terms_of(text_or_empty("text")).alias("terms"), F.col("label").cast("double").alias("label")).filter("label IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(*lists(b.column("terms")), b.column("label").to_numpy()) for b in batches if b.num_rows]
        if parts:
            sizes = np.concatenate([np.diff(o) for _, o, _ in parts])
            m = fit(np.concatenate([f for f, _, _ in parts]), np.r_[0, np.cumsum(sizes)], np.concatenate([y for _, _, y in parts]))
            yield pa.RecordBatch.from_pydict({"terms": [m.terms.tolist()], "w0": [m.w0], "w": [m.w.tolist()], "v": [m.v.ravel().tolist()], "f": [m.v.shape[1]]})

    got = rows.repartition(1).mapInArrow(run, "terms array<bigint>, w0 double, w array<double>, v array<double>, f bigint").collect()
    if not got:
        return Machine(np.zeros(0, int), -4.0, np.zeros(0), np.zeros((0, 1)))
    r = got[0]
    return Machine(np.array(r.terms, int), r.w0, np.array(r.w), np.array(r.v).reshape(-1, r.f))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = 12_000) -> DataFrame:
    """One row per row of ``docs``: doc_id and score (0 to 1).

    ``labels`` are the rows to learn from; at most ``sample`` of them are used,
    those of the smallest hashed ids.  Null and empty texts get the score of a
    text without known terms, rows without a label or an id are not learnt from,
    repeated rows are scored each and learnt from once; without labels every
    score is that of the prior.  Other columns are ignored, and an empty table
    gives no rows.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    chosen = labels.filter(F.col(label_col).isNotNull()).select(F.col(id_col).alias("own"), F.col(label_col).alias("label")).orderBy(F.xxhash64("own"), "own", "label").limit(sample).distinct()
    rows = texts.join(F.broadcast(chosen), F.col("doc_id") == F.col("own"))
    rows = rows.groupBy("own", "label", F.xxhash64("text").alias("th")).agg(F.first("text").alias("text"))  # many rows may share an id
    rows = rows.orderBy(F.xxhash64("own"), "own", "label", "th").limit(sample)
    model = spark.sparkContext.broadcast(train(rows.select("text", "label")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.value.scores(*lists(batch.column("terms"))))], ["doc_id", "score"])

    return texts.select("doc_id", terms_of(F.col("text")).alias("terms")).mapInArrow(run, f"doc_id {dict(docs.dtypes)[id_col]}, score double")


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = spread(spark.read.parquet(f"{sf_dir}/documents.parquet")), spark.read.parquet(f"{sf_dir}/labels.parquet")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    out = toxicity(docs, labels.filter(~held_out))
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
