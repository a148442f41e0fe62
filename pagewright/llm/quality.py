"""Quality classifier by importance resampling.

Two generative models of hashed n-grams are counted: the target's, over labelled
good texts, and the raw text's, over all documents.  A document's importance
weight is the log ratio of the two, summed over its n-grams, in nats; in a long
text the sum is drawn in, as if it had at most FULL_NGRAMS independent ones.
Documents are resampled without replacement by Gumbel top-k: the k greatest of
weight / temperature + Gumbel noise, which at temperature 1 draws one document
after the other in proportion to its likelihood ratio.

k is a parameter.  By default it is the number of documents whose weight is above a threshold that separates
labelled good and bad texts best.  The target model and the threshold are fitted
on a bounded sample of labelled rows (SAMPLE of each quality, by least hash of
the id), in halves; the raw model, the weights and the choice cover every row.

n-grams: words, word pairs, the words' shapes (case, trailing marks, repeat of
the word before) and pairs of shapes.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, bounded_join, free, map_batches, materialize, mixed, texts_of

BUCKETS = 1 << 14
#: Labelled rows of either quality that the target model and the threshold are fitted on.
SAMPLE = 10_000
SMOOTHING = 1.0
#: What a lost good document weighs against a kept bad one.
GOOD_WEIGHT = 4
TEMPERATURE = 1.0
#: n-grams of a text that count as independent: n of them weigh as n * FULL_NGRAMS / (n + FULL_NGRAMS) would.
FULL_NGRAMS = 200
SEED = "gumbel"
#: Words' ids remembered by a task.
CACHE = 60_000

_MARKS = re.compile(rb"[^0-9A-Za-z\x80-\xff]+")


def shape(word: bytes) -> bytes:
    """Case of the first letters and the marks in a word, e.g. b'Aa', b'AA!!', b'a***', b'|'; runs of letters count once."""
    letters = _MARKS.sub(b"", word)
    if not letters:
        return b"-" + word[:4]
    text = letters.decode("utf-8", "replace")
    case = b"0" if text[0].isdigit() else b"AA" if len(text) > 1 and text.isupper() else b"A" if text[0].isupper() else b"a"
    return case + b"".join(_MARKS.findall(word))[:4]


class Features:
    """Hashed n-grams of a text as bucket numbers."""

    def __init__(self, buckets: int = BUCKETS):
        self.mask = np.uint64(buckets - 1)
        self.words = WordHashes(CACHE)
        self.shapes: dict[bytes, int] = {}
        self.shape_hashes = WordHashes(50_000, seed=1)

    def _shape(self, word: bytes) -> int:
        found = self.shapes.get(word)
        if found is None:
            if len(self.shapes) >= CACHE:
                self.shapes.clear()
            found = self.shapes[word] = self.shape_hashes[shape(word)]
        return found

    def __call__(self, text: bytes) -> np.ndarray:
        words = text.split()
        if not words:
            return np.empty(0, np.int64)
        w = self.words.array(words)
        s = np.fromiter(map(self._shape, words), np.uint64, len(words))
        s[1:][w[1:] == w[:-1]] ^= np.uint64(0x5BD1E995)
        pairs = [mixed(x[:-1] * np.uint64(3) + x[1:]) for x in (w, s)]
        return (mixed(np.concatenate([w, s, *pairs])) & self.mask).astype(np.int64)


def labelled_sample(labels: DataFrame, size: int = SAMPLE) -> dict[int, tuple[int, bool]]:
    """doc_id -> (quality, in the half that fits); ``size`` ids of either quality at most.  Null ids or qualities are left out; of an id with two qualities, the lower holds."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).filter("doc_id is not null and quality in (0, 1)")
    rows = rows.groupBy("doc_id").agg(F.min("quality").alias("quality")).withColumn("u", F.xxhash64("doc_id", F.lit(7)))
    out: dict[int, tuple[int, bool]] = {}
    for q in (0, 1):
        for r in rows.filter(F.col("quality") == q).orderBy("u", "doc_id").limit(size).collect():
            out[r["doc_id"]] = (q, r["u"] & 1 == 0)
    return out


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def ngram_models(docs: DataFrame, sample: dict[int, tuple[int, bool]], buckets: int = BUCKETS) -> np.ndarray:
    """log(target) - log(raw) by bucket, from one pass over all documents; counts are summed per task before the shuffle."""
    good = {d for d, (q, fits) in sample.items() if q == 1 and fits}
    shared = docs.sparkSession.sparkContext.broadcast(good)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, raw, target = Features(buckets), np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), strict=True):
                found = features(text)
                np.add.at(raw, found, 1)
                if doc in shared.value:
                    np.add.at(target, found, 1)
        if raw.any():
            at = np.flatnonzero(raw)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw[at]), pa.array(target[at])], ["bucket", "raw", "target"])

    sums = map_batches(_texts(docs), run, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    raw, target = np.zeros(buckets), np.zeros(buckets)
    for r in sums.collect():  # at most ``buckets`` rows
        raw[r["bucket"]], target[r["bucket"]] = r["raw"], r["target"]
    if not target.any():
        return np.zeros(buckets)
    share = lambda x: np.log((x + SMOOTHING) / (x.sum() + SMOOTHING * buckets))
    return share(target) - share(raw)


def gumbel(doc: int | None, seed: str = SEED) -> float:
    """Reproducible noise of a row, from the first 52 bits of md5(seed:id)."""
    u = (int(hashlib.md5(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
    return -math.log(-math.log(u))


def ordered_bits(keys: np.ndarray) -> np.ndarray:
    """Doubles as longs that compare, as unsigned numbers, the way the doubles do."""
    bits = (keys + 0.0).view(np.uint64)
    return np.where(bits >> np.uint64(63), ~bits, bits | np.uint64(1 << 63)).view(np.int64)


def importance(docs: DataFrame, ratios: np.ndarray, temperature: float = TEMPERATURE, seed: str = SEED) -> DataFrame:
    """doc_id, n_ngrams, weight, key (weight / temperature + noise) and bits (the key's order) of each row."""
    shared, buckets = docs.sparkSession.sparkContext.broadcast(ratios), len(ratios)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, table = Features(buckets), shared.value
        for batch in batches:
            found = [features(t) for t in texts_of(batch.column(1))]
            n = np.array([len(x) for x in found], np.int64)
            weight = np.array([float(table[x].sum()) for x in found]) * (FULL_NGRAMS / (n + FULL_NGRAMS))
            keys = weight / temperature + np.array([gumbel(d, seed) for d in batch.column(0).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(weight), pa.array(keys), pa.array(ordered_bits(keys))], ["doc_id", "n_ngrams", "weight", "key", "bits"])

    return map_batches(_texts(docs), run, "doc_id long, n_ngrams long, weight double, key double, bits long")


def threshold(weights: np.ndarray, good: np.ndarray) -> float:
    """The weight that separates good from bad best, a share of good rows lost counting as GOOD_WEIGHT times a share of bad rows kept; -inf without rows of both kinds."""
    if not good.any() or good.all():
        return float("-inf")
    order = np.argsort(weights, kind="stable")
    w, g = weights[order], good[order]
    kept_good = 1 - np.concatenate([[0], np.cumsum(g)]) / g.sum()
    dropped_bad = np.concatenate([[0], np.cumsum(~g)]) / (~g).sum()
    score = GOOD_WEIGHT * kept_good + dropped_bad
    cuts = np.concatenate([[True], w[1:] > w[:-1], [False]])  # no cut inside a tie
    best = int(np.argmax(np.where(cuts, score, -1)))
    return float("-inf") if best == 0 else float((w[best - 1] + w[best]) / 2)


def radix_cut(keys: DataFrame, k: int) -> int | None:
    """The k-th greatest of the long column ``bits``, taken as unsigned, found on histograms of its digits; None if there are fewer.

    16 bits a step, so no step brings more than 65,536 rows to the driver."""
    bits = F.col("bits")
    prefix, left = None, k
    for shift in (48, 32, 16, 0):
        at = keys if prefix is None else keys.filter(F.shiftrightunsigned(bits, shift + 16) == F.lit(prefix))
        counts = at.groupBy(F.shiftrightunsigned(bits, shift).alias("d")).agg(F.count(F.lit(1)).alias("c")).collect()
        for row in sorted(counts, key=lambda r: -(r["d"] % 2**64)):
            if row["c"] >= left:
                prefix = row["d"]
                break
            left -= row["c"]
        else:
            return None
    return prefix % 2**64


def resample(docs: DataFrame, labels: DataFrame, temperature: float = TEMPERATURE, k: int | None = None, size: int = SAMPLE, seed: str = SEED) -> DataFrame:
    """doc_id, n_ngrams, weight, key and kept for each row of ``docs`` (doc_id, text; other columns are ignored).

    ``k`` documents are kept (default: as many as have weights above the fitted
    threshold).  Keys are compared bit by bit, so more than k are kept only where
    rows have the very same key as the last one, such as repeated rows.  Null and
    empty texts have weight 0 and no n-grams and are rejected.  Without labelled
    good and bad rows, all rows with n-grams are kept.
    """
    sample = labelled_sample(labels, size)
    scored = materialize(importance(docs, ngram_models(docs, sample), temperature, seed), "quality-weights")
    if k is None:
        ids = docs.sparkSession.createDataFrame(pd.DataFrame({"doc_id": pd.Series([d for d in sample], dtype="int64"), "good": pd.Series([q == 1 for q, _ in sample.values()], dtype="bool"), "fits": pd.Series([f for _, f in sample.values()], dtype="bool")}), "doc_id long, good boolean, fits boolean")
        known = scored.join(F.broadcast(ids), "doc_id").filter("not fits and n_ngrams > 0").groupBy("doc_id", "good").agg(F.min("weight").alias("weight")).toPandas()  # one row for each id of the sample at most
        cut = threshold(known["weight"].to_numpy(), known["good"].to_numpy(dtype=bool))
        k = scored.filter((F.col("weight") >= cut) & (F.col("n_ngrams") > 0)).count()
    cut = radix_cut(scored.filter("n_ngrams > 0"), k) if k > 0 else 2**64 - 1
    signed = lambda x: x.bitwiseXOR(F.lit(-(2**63)))
    kept = (F.col("n_ngrams") > 0) & (F.lit(True) if cut is None else signed(F.col("bits")) >= F.lit(cut - 2**63))
    return scored.withColumn("kept", kept).select("doc_id", "n_ngrams", "weight", "key", "kept")


def good_documents(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that the classifier keeps, with their columns; rows that repeat a doc_id are kept if one of them is, null ids if one of those is."""
    key = free(docs, "row_id")
    got = resample(docs, labels, **options).groupBy("doc_id").agg(F.max("kept").alias("kept"))
    out = materialize(got.filter("not kept").select(F.coalesce("doc_id", F.lit(-(2**63))).alias(key)), "quality-dropped")
    named = docs.withColumn(key, F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))))
    return bounded_join(named, out, [key], "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
