"""Quality by weak supervision: heuristic labellers, a label model, a hashed linear scorer.

Labellers vote good, junk or nothing on each document.  Expectation-maximisation
over the counts of vote patterns of all documents estimates how often each
labeller votes what for good and for junk text; the posterior labels of a
bounded sample train a linear scorer over hashed words and hashed runs of
character classes, which scores every document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, portioned, some_rows, spread, text_or_empty, texts_of, unused

#: Classes of bytes: lower case, upper case, digit, blank, line end, stop, comma and the like, other signs, bytes of non-ASCII letters.
CLASS = np.full(256, 7, np.int64)
for _name, _bytes in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\r\n", b".?", b",;:'-")):
    CLASS[list(_bytes)] = _name
CLASS[128:] = 8
#: Hash buckets of runs of GRAM classes, and of words.
GRAM, BUCKETS, WORDS = 4, 2048, 4096
#: Bytes and rows that are worked on at a time; a longer text is read in pieces of so many bytes.
SIZE, ROWS, PIECE = 1 << 20, 500, 2 << 20
#: Shares that say nothing of a text of fewer words.
MANY = 12
#: Named shares beside the hashed runs of classes.
SHARES = ["plain", "signs", "upper", "pipes", "again", "top"]
GOOD, JUNK, NONE = 1, 0, 2


class Texts:
    """What labellers and scorer need of a batch of texts, from their bytes."""

    def __init__(self, column: pa.Array):
        self.raw, self.offsets = texts_of(column)
        self.n = len(column)
        self.kinds = CLASS[self.raw]
        self.doc = np.repeat(np.arange(self.n), np.diff(self.offsets))
        self.words, self.word_doc = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # hashes, set by ``shares``

    def per_doc(self, mask: np.ndarray, doc: np.ndarray | None = None) -> np.ndarray:
        return np.bincount((self.doc if doc is None else doc)[mask], minlength=self.n).astype(float)

    def counts(self) -> dict[str, np.ndarray]:
        """Words of each document and how many of them are of a kind; the counts behind ``shares``."""
        kinds, gap = self.kinds, (self.kinds == 3) | (self.kinds == 4)
        edge = np.zeros(len(kinds), bool)
        edge[self.offsets[:-1][self.offsets[:-1] < len(kinds)]] = True
        begin = ~gap & (np.r_[True, gap[:-1]][: len(gap)] | edge)
        starts = np.flatnonzero(begin)
        if not len(starts):
            self.words, self.word_doc = np.zeros(0, np.uint64), np.zeros(0, np.int64)
            return {name: np.zeros(self.n) for name in ["words", *SHARES]}
        doc = self.doc[starts]
        word = np.maximum(np.cumsum(begin) - 1, 0)
        power = np.cumprod(np.full(64, 0x9E3779B97F4A7C15, np.uint64))
        mixed = np.where(gap, np.uint64(0), (self.raw.astype(np.uint64) + np.uint64(1)) * power[np.minimum(np.arange(len(kinds)) - starts[word], 63)])
        code = np.add.reduceat(mixed, starts)
        count = lambda kind: np.add.reduceat(kind.astype(np.int32), starts)
        letters, upper, size = count((kinds == 0) | (kinds == 8)), count(kinds == 1), count(~gap)
        ends = count((kinds == 5) | (kinds == 6))
        plain = (letters + (upper <= 1) * upper + np.minimum(ends, 2) >= size) & (letters + upper > 0)
        signs = count(kinds == 7) > 0
        pipe = (size == 1) & (self.raw[starts] == ord("|"))
        again = np.r_[False, (code[1:] == code[:-1]) & (doc[1:] == doc[:-1])]
        self.words, self.word_doc = code, doc
        words = np.bincount(doc, minlength=self.n).astype(float)
        order = np.lexsort((code, doc))
        d, c = doc[order], code[order]
        runs = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (c[1:] != c[:-1])])
        top = np.zeros(self.n)
        np.maximum.at(top, d[runs], np.diff(np.r_[runs, len(d)]))
        shouted = (upper >= 2) & (letters - 2 <= upper)
        return {"words": words, "plain": self.per_doc(plain, doc), "signs": self.per_doc(signs & ~pipe, doc), "upper": self.per_doc(shouted, doc), "pipes": self.per_doc(pipe, doc), "again": self.per_doc(again, doc), "top": top}

    def shares(self) -> dict[str, np.ndarray]:
        made = self.counts()
        words = made.pop("words")
        for name in ("upper", "again", "top"):
            made[name] = np.where(words >= MANY, made[name], 0)
        return {"words": words} | {k: v / np.maximum(words, 1) for k, v in made.items()}

    def buckets(self) -> list[np.ndarray]:
        """How often each document has each bucket, of runs of classes and of words."""
        return [np.bincount(doc * size + bucket, minlength=self.n * size).reshape(self.n, size) for (doc, bucket), size in zip(self.hashed(), (BUCKETS, WORDS))]

    def hashed(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """(document, bucket) of each run of classes, and of each word."""
        codes = np.zeros(max(len(self.kinds) - GRAM + 1, 0), np.int64)
        for i in range(GRAM):
            codes = codes * 9 + self.kinds[i : len(self.kinds) - GRAM + 1 + i]
        first, last = self.doc[: len(codes)], self.doc[GRAM - 1 :]
        whole = first == last
        words = self.words * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(52)
        return [(first[whole], (codes[whole] * 2654435761 >> 7) % BUCKETS), (self.word_doc, words.astype(np.int64) % WORDS)]


class LongText(Texts):
    """What ``Texts`` gives of one very long text, read in pieces that end between words: only a piece's numbers are held, and its distinct words."""

    def __init__(self, column: pa.Array):
        self.raw, self.n = texts_of(column)[0], 1

    def pieces(self) -> Iterator[tuple[int, Texts]]:
        """(first byte, numbers) of each piece."""
        at = 0
        while at < len(self.raw):
            to = min(at + PIECE, len(self.raw))
            while to < len(self.raw):
                gaps = np.flatnonzero((CLASS[self.raw[max(at, to - PIECE) : to]] == 3) | (CLASS[self.raw[max(at, to - PIECE) : to]] == 4))
                if len(gaps):
                    to = max(at, to - PIECE) + int(gaps[-1]) + 1
                    break
                to = min(to + PIECE, len(self.raw))  # a word longer than a piece
            piece = np.ascontiguousarray(self.raw[at:to])
            yield at, Texts(pa.Array.from_buffers(pa.binary(), 1, [None, pa.py_buffer(np.array([0, len(piece)], np.int32)), pa.py_buffer(piece)]))
            at = to

    def counts(self) -> dict[str, np.ndarray]:
        total = {name: np.zeros(1) for name in ["words", *SHARES]}
        known, often, last = np.zeros(0, np.uint64), np.zeros(0, np.int64), None
        for _, piece in self.pieces():
            for name, v in piece.counts().items():
                total[name] += v
            if len(piece.words):
                total["again"] += last is not None and piece.words[0] == last
                last = piece.words[-1]
                own, n = np.unique(piece.words, return_counts=True)
                known, where = np.unique(np.r_[known, own], return_inverse=True)
                often = np.bincount(where, np.r_[often, n], len(known)).astype(np.int64)
        total["top"] = np.array([float(often.max(initial=0))])
        return total

    def buckets(self) -> list[np.ndarray]:
        made = [np.zeros((1, size), np.int64) for size in (BUCKETS, WORDS)]
        for at, piece in self.pieces():
            piece.counts()  # sets the words
            begin = max(at - GRAM + 1, 0)  # runs of classes go on over the ends of pieces
            piece.kinds, piece.doc = CLASS[self.raw[begin : at + len(piece.raw)]], np.zeros(at - begin + len(piece.raw), np.int64)
            for total, own in zip(made, piece.buckets()):
                total += own
        return made


def read(column: pa.Array) -> Texts:
    """The numbers of some texts, or of one that is longer than a piece."""
    return LongText(column) if len(column) == 1 and len(texts_of(column)[0]) > PIECE else Texts(column)


def votes(s: dict[str, np.ndarray]) -> np.ndarray:
    """One column per labeller."""
    plain, signs, upper, pipes, again, top = (s[name] for name in SHARES)
    prose = (plain > 0.8) & (signs < 0.02) & (upper < 0.1) & (pipes < 0.02) & (again < 0.05) & (top < 0.15)
    vote = lambda junk, good=False: np.where(junk, JUNK, np.where(good, GOOD, NONE))
    return np.stack([
        vote(plain < 0.6, prose),
        vote(signs > 0.3),
        vote(upper > 0.4),
        vote(pipes > 0.15),
        vote(again > 0.25),
        vote(top > 0.3),
    ], axis=1)


def label_model(patterns: np.ndarray, counts: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Posterior probability of good for each pattern of votes.

    Votes are taken as independent given the class; each labeller has its own
    probabilities of each vote for either class.  Without any votes all are good.
    """
    if not len(patterns):
        return np.zeros(0)
    junk = (patterns == JUNK).sum(axis=1)
    good = np.where(junk > 0, 0.1, 0.95)
    for _ in range(rounds):
        logs = []
        for weight in (counts * (1 - good), counts * good):
            total = np.log((weight.sum() + 1) / (counts.sum() + 2))
            for column in patterns.T:
                chance = np.array([weight[column == v].sum() + 0.5 for v in (JUNK, GOOD, NONE)])
                total = total + np.log(chance / chance.sum())[column]
            logs.append(total)
        good = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -50, 50)))
    return good


def features(texts: Texts, shares: dict[str, np.ndarray]) -> np.ndarray:
    """A row for each document: frequencies of buckets, shares and a one."""
    made = [flat / np.maximum(flat.sum(axis=1, keepdims=True), 1) for flat in texts.buckets()]
    return np.hstack([*made, *(shares[name][:, None] for name in SHARES), np.ones((texts.n, 1))]).astype(np.float32)


def margins(texts: Texts, shares: dict[str, np.ndarray], w: np.ndarray) -> np.ndarray:
    """The rows of ``features`` times the weights, without making them (but that of a text in pieces)."""
    if isinstance(texts, LongText):
        return features(texts, shares) @ w
    out = np.stack([shares[name] for name in SHARES], axis=1) @ w[BUCKETS + WORDS : -1] + w[-1]
    for (doc, bucket), own in zip(texts.hashed(), (w[:BUCKETS], w[BUCKETS : BUCKETS + WORDS])):
        out += np.bincount(doc, own[bucket], texts.n) / np.maximum(np.bincount(doc, minlength=texts.n), 1)
    return out


def fit_linear(x: np.ndarray, y: np.ndarray, steps: int = 200, rate: float = 0.5, decay: float = 1e-4) -> np.ndarray:
    """Logistic regression on soft labels, by full gradient steps of adapted size."""
    x, y = x.astype(np.float32), y.astype(np.float32)
    w, seen = np.zeros(x.shape[1], np.float32), np.zeros(x.shape[1], np.float32)
    weight = np.where(y > 0.5, 0.5 / max(y.mean(), 1e-3), 0.5 / max(1 - y.mean(), 1e-3))
    for _ in range(steps):
        g = x.T @ (weight * (1 / (1 + np.exp(-(x @ w))) - y)) / len(y) + decay * w
        seen += g * g
        w -= rate * g / np.sqrt(seen + 1e-12)
    return w


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = 2000) -> DataFrame:
    """One row per row of ``docs``: its columns and ``quality_score``, the probability of good text.

    The scorer is fitted on at most ``sample`` documents, those of the smallest
    hashed ids and texts; vote counts are over all.  Null texts count as empty;
    texts without words get the score of an empty feature row; rows that repeat
    get equal scores and are learnt from once; a null id is one like others; a
    column named ``quality_score`` is replaced; a very long text is read in
    pieces; an empty table gives no rows.
    """
    spark = docs.sparkSession
    texts = docs.select(text_or_empty(text_col).alias("text"))

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in portioned(batch, "text", SIZE, ROWS):
                v = votes(read(part.column("text")).shares())
                yield pa.RecordBatch.from_arrays([pa.array(v @ (3 ** np.arange(v.shape[1])))], ["pattern"])
        give_back()

    counted = texts.mapInArrow(vote, "pattern bigint").groupBy("pattern").count().collect()  # 3 to the number of labellers rows at most
    numbers = np.array([r.pattern for r in counted], np.int64)
    good = dict(zip(numbers.tolist(), label_model(numbers[:, None] // 3 ** np.arange(6) % 3, np.array([float(r["count"]) for r in counted])).tolist()))
    rows = some_rows(docs, sample, id_col, text_col).select("text")

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        xs, ys = [], []
        for batch in batches:
            for part in portioned(batch, "text", SIZE, ROWS):
                t = read(part.column("text"))
                shares = t.shares()
                v = votes(shares)
                xs.append(features(t, shares))
                ys += [good[p] for p in (v @ (3 ** np.arange(v.shape[1]))).tolist()]
        if ys:
            yield pa.RecordBatch.from_arrays([pa.array([fit_linear(np.vstack(xs), np.array(ys)).tolist()])], ["w"])
        del xs, ys
        give_back()

    fitted = rows.repartition(1).mapInArrow(fit, "w array<double>").collect()  # one row, from the bounded sample
    weights = spark.sparkContext.broadcast(np.array(fitted[0].w if fitted else np.zeros(BUCKETS + WORDS + len(SHARES) + 1)))
    schema = docs.withColumn("quality_score", F.lit(0.0)).schema  # a copy: adding to docs.schema would change docs
    text = unused(docs, "text_")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = weights.value
        for batch in batches:
            values = []
            for part in portioned(batch, text, SIZE, ROWS):
                t = read(part.column(text))
                values.append(1 / (1 + np.exp(-np.clip(margins(t, t.shares(), w), -50, 50))))
            made = {c: batch.column(c) for c in batch.schema.names if c != text}
            made["quality_score"] = pa.array(np.concatenate(values) if values else np.zeros(0))
            yield pa.RecordBatch.from_pydict(made)
        give_back()

    return docs.withColumn(text, text_or_empty(text_col)).mapInArrow(score, schema)


def op6_quality(spark, sf_dir: str) -> DataFrame:
    out = quality(spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")))
    return out.select("doc_id", F.col("quality_score").alias("score"), (F.col("quality_score") >= 0.5).cast("int").alias("predicted"))
