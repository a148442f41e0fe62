"""Language-model scoring of whole documents.

Counting covers all words of the training documents.  The commonest words are
the model's vocabulary; all others are 16 kinds of rare word (by their last
character, length and alphabet), and a rare word's probability is its kind's,
from the recurrent model, times its smoothed share of the kind, from the counts.

Texts are then coded once: a table has each document's model ids (two bytes a
token) and its rare words, and both training and scoring read that.  Training
documents are dealt by their id into shards of about SHARD_TOKENS tokens, of
which the rounds take 1, 2, 4, 8 and so on, each shard in one round: a copy of
the model is trained on each shard of a round, in the order of the ids, and the
copies' token-weighted mean goes on.  So the rounds grow with the data, and as
means are exact sums of integers, the model does not depend on how the data are
partitioned.  Vectors are summed in the tasks and then in about sqrt(tasks)
tasks, so the driver receives that many.  Counts of common words go to every
task (at most HOT_WORDS); the others meet their documents' rare words in a join.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import gru
from .common import listed, lower_words, map_batches, materialize, merged

CLASSES, WORDS, HIDDEN, EMBED = 32, 32, 16, 16
KINDS = 16
HOT_WORDS = 1 << 18
RATE = 0.05
#: Tokens that a shard of the training documents has about, and the least number of shards.
SHARD_TOKENS, LEAST_SHARDS = 500_000, 8
#: Tasks of a training round; more shards than that share tasks.
MOST_TASKS = 20_000
#: Parameters are averaged as integers of this unit, weighted by so many tokens.
UNIT, WEIGHT_TOKENS = 2.0**-24, 512
#: Tokens that are packed into lanes together, words whose counts a task holds, and bytes of text that are parted together.
BLOCK_TOKENS, HELD_WORDS, SLICE_BYTES = 600_000, 600_000, 8_000_000
END = -1
#: By byte: what a last character adds to the kind of its word, and which are no ASCII letters or digits.
_LAST = np.zeros(256, np.int64)
_LAST[list(b".!?")], _LAST[list(b",;:*#$%&\"')")] = 1, 2
_OTHER = np.array([not bytes([x]).isalnum() for x in range(256)])


def word_keys(words: pa.Array) -> np.ndarray:
    """A 63-bit hash of each word (not empty) whose low four bits are its kind."""
    if not len(words):
        return np.empty(0, np.int64)
    offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    letters = np.frombuffer(words.buffers()[2], np.uint8)[: offsets[-1]]
    length, last = np.diff(offsets), _LAST[letters[offsets[1:] - 1]]
    ascii_ = np.maximum.reduceat(letters, offsets[:-1]) < 128
    kind = np.where((last == 0) & ascii_ & np.logical_or.reduceat(_OTHER[letters], offsets[:-1]), 12 + (length > 3), last + 3 * (length > 6) + 6 * ~ascii_)
    digests = np.fromiter(map(xxhash.xxh3_64_intdigest, listed(words)), np.uint64, len(words))
    return (digests >> np.uint64(1)).astype(np.int64) & ~15 | kind


def remainder(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text (null as the empty text), modulo 7."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 7


def word_counts(docs: DataFrame) -> DataFrame:
    """key and n of each distinct word of ``docs`` (key END: documents), summed per task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, ends = [], 0

        def flush() -> pa.RecordBatch:
            keys, place = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
            counts = np.bincount(place, np.concatenate([c for _, c in held]), len(keys)).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(np.append(keys, END)), pa.array(np.append(counts, ends))], ["key", "n"])

        for batch in merged(batches, SLICE_BYTES):
            words, _ = lower_words(batch.column(0))
            held.append((word_keys(words.dictionary), np.bincount(words.indices.to_numpy(), minlength=len(words.dictionary))))
            ends += batch.num_rows
            if sum(len(k) for k, _ in held) > HELD_WORDS:
                yield flush()
                held, ends = [], 0
        if ends:
            yield flush()

    return map_batches(docs.select(F.col("text").cast("string")), run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def _at_most(words: DataFrame, bins: dict[int, int], limit: int) -> int:
    """The least bin such that the words in it and above are ``limit`` at most."""
    total, least = 0, max(bins, default=0) + 1
    for b in sorted(bins, reverse=True):
        if total + bins[b] > limit:
            break
        total, least = total + bins[b], b
    return least


class Statistics:
    """What every task needs of the counts; its size is bounded by HOT_WORDS."""

    def __init__(self, counts: DataFrame):
        words = counts.filter(F.col("key") != END).withColumn("bin", F.when(F.col("n") < 4096, F.col("n")).otherwise(F.floor(F.log2("n") * 256) + 1024).cast("long"))
        total = counts.agg(F.sum("n"), F.count(F.lit(1)), F.sum(F.when(F.col("key") == END, F.col("n")))).first()
        self.n, self.v, self.ends = (int(x or 0) for x in total)
        bins = {r["bin"]: r["c"] for r in words.groupBy("bin").agg(F.count(F.lit(1)).alias("c")).collect()}
        kinds = {r["kind"]: (r["n"], r["v"]) for r in words.groupBy(F.col("key").bitwiseAND(15).alias("kind")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect()}
        self.hot_bin = _at_most(words, bins, HOT_WORDS)
        hot = words.filter(F.col("bin") >= self.hot_bin).select("key", "n").toPandas().sort_values(["n", "key"], ascending=[False, True])
        self.keys, self.counts = hot["key"].to_numpy(np.int64), hot["n"].to_numpy(np.int64)
        # Model ids: 0 the end, 1..KINDS the kinds of rare words, then the commonest words.
        self.vocabulary = min(len(self.keys), CLASSES * WORDS - KINDS - 1)
        self.rare_n, self.rare_v = (np.array([kinds.get(k, (0, 0))[i] for k in range(KINDS)], np.int64) for i in range(2))
        for key, n in zip(self.keys[: self.vocabulary], self.counts[: self.vocabulary], strict=True):
            self.rare_n[key & 15] -= n
            self.rare_v[key & 15] -= 1
        self.unigram = np.zeros(CLASSES * WORDS)
        self.unigram[0], self.unigram[1 : KINDS + 1] = self.ends, self.rare_n
        self.unigram[KINDS + 1 : KINDS + 1 + self.vocabulary] = self.counts[: self.vocabulary]

    def base_log(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 1) / (self.n + self.v + 1))

    def rare_log(self, counts: np.ndarray, kinds: np.ndarray) -> np.ndarray:
        return np.log10((counts + 1) / (self.rare_n[kinds] + self.rare_v[kinds] + 1))


class Codes:
    """Places of words among the hot words, or -1 - key for other words."""

    def __init__(self, statistics: Statistics):
        self.order = np.argsort(statistics.keys)
        self.keys = statistics.keys[self.order]

    def of(self, words: pa.Array) -> np.ndarray:
        keys = word_keys(words)
        if not len(self.keys):
            return -1 - keys
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.order[at], -1 - keys)


def model_ids(codes: np.ndarray, statistics: Statistics) -> np.ndarray:
    """Model ids of words by their codes."""
    rare = codes >= statistics.vocabulary
    unknown = codes < 0
    ids = codes + 1 + KINDS
    if rare.any():
        ids[rare] = 1 + (statistics.keys[codes[rare]] & 15)
    ids[unknown] = 1 + ((-1 - codes[unknown]) & 15)
    return ids


def _model(statistics: Statistics) -> gru.Model:
    return gru.Model(CLASSES, WORDS, HIDDEN, EMBED, statistics.unigram)


def coded(docs: DataFrame, learns: Column, shared: Broadcast) -> DataFrame:
    """Each row's row (a number), doc_id, learns, model ids (uint16), counts and logs of its hot words, and rare words with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        codes = Codes(own)
        hot_base = own.base_log(own.counts.astype(np.float64))
        hot_rare = np.where(np.arange(len(own.keys)) < own.vocabulary, 0.0, own.rare_log(own.counts.astype(np.float64), own.keys & 15))
        end = float(own.base_log(np.array([float(own.ends)]))[0])
        row = TaskContext.get().partitionId() << 33
        for batch in merged(batches, SLICE_BYTES):
            words, counts = lower_words(batch.column(1))
            n, at, distinct = len(counts), words.indices.to_numpy(), codes.of(words.dictionary)
            ends, text = np.cumsum(counts), np.repeat(np.arange(n), counts)
            ids = np.insert(model_ids(distinct, own).astype("<u2")[at], ends, 0)
            hot = (distinct >= 0)[at]
            hot_at, hot_text = distinct[at[hot]], text[hot]
            pairs, times = np.unique(text[~hot] * max(len(distinct), 1) + at[~hot], return_counts=True)
            rare = np.concatenate([[0], np.cumsum(np.bincount(pairs // max(len(distinct), 1), minlength=n))]).astype(np.int32)
            arrays = [
                pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(2 * np.concatenate([[0], ends + np.arange(1, n + 1)])), pa.py_buffer(ids)]).cast(pa.binary()),
                pa.array(counts + 1), pa.array(np.bincount(hot_text, minlength=n) + (own.ends > 0)),
                pa.array(np.bincount(hot_text, hot_base[hot_at], n) + end), pa.array(np.bincount(hot_text, hot_rare[hot_at], n)),
                pa.ListArray.from_arrays(rare, pa.array(-1 - distinct[pairs % max(len(distinct), 1)])), pa.ListArray.from_arrays(rare, pa.array(times)),
            ]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + n)), batch.column(0), batch.column(2), *arrays], ["row", "doc_id", "learns", "ids", "n_tokens", "n_known", "base_score", "hot_score", "rare", "times"])
            row += n

    return materialize(map_batches(docs.withColumn("learns", learns), run, "row long, doc_id long, learns boolean, ids binary, n_tokens long, n_known long, base_score double, hot_score double, rare array<long>, times array<long>"), "lm-coded")


def _ids(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x, "<u2").astype(np.int32) for x in column.to_pylist()]


def learn(model: gru.Model, docs: Iterator[np.ndarray], rate: float) -> int:
    """One pass over a shard's documents, every window backpropagated; returns their tokens.  BLOCK_TOKENS tokens are held at once."""
    optimizer, block, held, seen = gru.Adam(model, rate), [], 0, 0
    for d in docs:
        block.append(d)
        held += len(d)
        if held >= BLOCK_TOKENS:
            seen += gru.train(model, optimizer, block)
            block, held = [], 0
    return seen + (gru.train(model, optimizer, block) if block else 0)


def _summed(weight: int, total: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([weight], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["weight", "total"])


def train(rows: DataFrame, statistics: Statistics, shared: Broadcast, shard_tokens: int = SHARD_TOKENS, least_shards: int = LEAST_SHARDS) -> np.ndarray:
    """Parameters after all rounds.  ``rows`` (doc_id, ids): each is used in one round, whole.  Rows that repeat an id are in one shard."""
    spark = rows.sparkSession
    vector = _model(statistics).vector()
    n = max(least_shards, -(-statistics.n // shard_tokens))
    sharded = rows.select(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(n)).alias("shard"), "doc_id", "ids")
    at, size, r = 0, 1, 0
    while at < n:
        start = spark.sparkContext.broadcast(vector)

        def run(batches: Iterator[pa.RecordBatch], start=start, r=r) -> Iterator[pa.RecordBatch]:
            own, weight, total = shared.value, 0, 0
            docs = ((s, d) for batch in batches for s, d in zip(batch.column(0).to_pylist(), _ids(batch.column(1)), strict=True))
            for _, group in groupby(docs, key=itemgetter(0)):
                model = _model(own).load(start.value)
                w = max(1, learn(model, (d for _, d in group), RATE / (1 + r)) // WEIGHT_TOKENS)
                weight, total = weight + w, total + w * np.rint(model.vector().astype(np.float64) / UNIT).astype(np.int64)
            if weight:
                yield _summed(weight, total)

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            weight, total = 0, 0
            for batch in batches:
                for w, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    weight, total = weight + w, total + np.frombuffer(v, np.int64)
            if weight:
                yield _summed(weight, total)

        tasks = min(size, n - at, MOST_TASKS)
        own = sharded.filter((F.col("shard") >= at) & (F.col("shard") < at + size)).repartition(tasks, "shard").sortWithinPartitions("shard", "doc_id", "ids")
        copies = map_batches(own.select("shard", "ids"), run, "weight long, total binary")
        sums = map_batches(copies.repartition(max(1, round(tasks**0.5))), add, "weight long, total binary").collect()
        if sums:
            vector = (sum(np.frombuffer(x["total"], np.int64) for x in sums) / sum(x["weight"] for x in sums) * UNIT).astype(np.float32)
        at, size, r = at + size, 2 * size, r + 1
    return vector


def score_documents(docs: DataFrame, training: Column | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (both log10) for each row of ``docs`` (doc_id, text).

    ``training`` chooses the documents to learn from (default: crc32 of the id as
    text, modulo 7, is not 2).  Null and empty texts have the end token alone;
    rows that repeat an id are scored each by its own text; an empty table gives
    an empty result; other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    learns = remainder() != 2 if training is None else F.coalesce(training, F.lit(False))
    counts = materialize(word_counts(docs.filter(learns)), "lm-counts")
    statistics = Statistics(counts)
    shared = docs.sparkSession.sparkContext.broadcast(statistics)
    rows = coded(docs, learns, shared)
    trained = docs.sparkSession.sparkContext.broadcast(train(rows.filter("learns"), statistics, shared))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(shared.value).load(trained.value)

        def scored(block: list[pa.RecordBatch]) -> pa.RecordBatch:
            table = pa.Table.from_batches(block).combine_chunks().to_batches()[0]
            score = gru.score(model, _ids(table.column("ids"))) / np.log(10) + table.column("hot_score").to_numpy()
            return pa.RecordBatch.from_arrays([*[table.column(c) for c in ("row", "doc_id", "n_tokens", "n_known", "base_score")], pa.array(score)], ["row", "doc_id", "n_tokens", "n_known", "base_score", "score"])

        block, held = [], 0
        for batch in batches:
            block.append(batch)
            held += pc.sum(batch.column("n_tokens")).as_py() or 0
            if held >= BLOCK_TOKENS:
                yield scored(block)
                block, held = [], 0
        if held:
            yield scored(block)

    scores = map_batches(rows.select("row", "doc_id", "n_tokens", "n_known", "base_score", "hot_score", "ids"), run, "row long, doc_id long, n_tokens long, n_known long, base_score double, score double")
    rare = rows.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("key"), F.col("x.times").alias("t"))
    c = F.coalesce(F.col("n"), F.lit(0)).cast("double")
    kinds = F.array(*[F.lit(float(x + y + 1)) for x, y in zip(statistics.rare_n, statistics.rare_v, strict=True)])
    joined = rare.join(counts, "key", "left").groupBy("row").agg(
        F.sum(F.when(F.col("n") > 0, F.col("t")).otherwise(0)).alias("more_known"),
        F.sum(F.col("t") * F.log10((c + 1) / F.lit(float(statistics.n + statistics.v + 1)))).alias("more_base"),
        F.sum(F.col("t") * F.log10((c + 1) / F.element_at(kinds, (F.col("key").bitwiseAND(15) + 1).cast("int")))).alias("more_score"),
    )
    zero = lambda x: F.coalesce(F.col(x), F.lit(0))
    return scores.join(joined, "row", "left").select("doc_id", (remainder() == 2).alias("held_out"), "n_tokens", (F.col("n_known") + zero("more_known")).alias("n_known"), F.lit(statistics.n).cast("long").alias("train_tokens"), (F.col("base_score") + zero("more_base")).alias("base_score"), (F.col("score") + zero("more_score")).alias("score"))
