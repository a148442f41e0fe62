"""Quality rules: an isolation forest on rule statistics.

One pass takes each text's rule statistics.  Trees of random splits are grown on
labelled good rows, as the method has it each on 256 of all of them; a document's anomaly score is
2 ** (-mean path length / expected path length), and the threshold between
labelled good and bad rows is calibrated on all the other labelled rows.  A document
is kept if no base rule fails it and its score is below the threshold.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WordHashes, bounded_join, map_batches, materialize, texts_of, window_hashes
from .quality import GOOD_WEIGHT

TREES, PSI = 100, 256
MIN_WORDS, REPEAT_PERCENT, WINDOW = 20, 30, 8
SYMBOLS = b"#*$%&|<>"
_DROP = bytes(x for x in range(256) if x not in SYMBOLS)
_CONTINUATION = bytes(range(0x80, 0xC0))

#: Exact statistics of a row, longs.
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks", "n_same", "n_distinct", "n_digits"]
#: What the forest splits on: shares, so that a text's length alone is no anomaly.
FEATURES = ["mean_chars", "symbols", "dup_lines", "repeats", "upper", "marks", "same", "digits"]

_UPPER = re.compile(rb"(?<![a-z\x80-\xff])[A-Z]{2,}(?![a-z])")


def statistics(text: bytes, hashes: WordHashes) -> list[int]:
    """COUNTS of one text; all 0 for an empty one."""
    words = text.split()
    n = len(words)
    if not n:
        return [0] * len(COUNTS)
    ids = hashes.array(words)
    repeats = 0
    if n >= WINDOW + 1:
        windows = window_hashes(ids, WINDOW)
        _, inverse, counts = np.unique(windows, return_inverse=True, return_counts=True)
        if len(counts) < len(windows):
            starts = np.flatnonzero(counts[inverse] > 1)
            step = np.zeros(n + 1, np.int64)
            np.add.at(step, starts, 1)
            np.add.at(step, starts + WINDOW, -1)
            repeats = int(np.count_nonzero(np.cumsum(step[:-1])))
    seen: set[bytes] = set()
    lines = dups = 0
    for line in text.split(b"\n"):
        if line and not line.isspace():
            lines += 1
            if line in seen:
                dups += 1
            else:
                seen.add(line)
    joined = b"".join(words)
    chars = len(joined.translate(None, _CONTINUATION))
    symbols = len(text.translate(None, _DROP))
    letters = len(joined.translate(None, b"!\"#$%&'()*+,-./0123456789:;<=>?@[\\]^_`{|}~"))
    digits = len(joined) - len(joined.translate(None, b"0123456789"))
    upper = sum(map(len, _UPPER.findall(text)))
    same = int(np.count_nonzero(ids[1:] == ids[:-1]))
    return [n, chars, symbols, dups, repeats, lines, upper, len(joined) - letters - digits, same, len(np.unique(ids)), digits]


def rule_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and COUNTS of every row's whole text; null text has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            rows = np.array([statistics(t, hashes) for t in texts_of(batch.column(1))], np.int64).reshape(-1, len(COUNTS))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(rows[:, i]) for i in range(len(COUNTS))]], ["doc_id", *COUNTS])

    return map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS))


def features(p: pd.DataFrame) -> np.ndarray:
    n, chars = np.maximum(p["n_words"].to_numpy(float), 1), np.maximum(p["word_chars"].to_numpy(float), 1)
    lines = np.maximum(p["n_lines"].to_numpy(float), 1)
    # A mean over few words scatters, which is no fault: it is drawn towards the usual length.
    mean = (p["word_chars"].to_numpy(float) + 5.0 * 50) / (n + 50)
    columns = [mean, p["n_symbols"] / chars, p["n_dup_lines"] / lines, p["n_repeat_words"] / n, p["n_upper"] / (chars + 100), p["n_marks"] / (chars + 100), p["n_same"] / (n + 20), p["n_digits"] / (chars + 200)]
    return np.column_stack([np.asarray(c, float) for c in columns])


def usual_path(n: float) -> float:
    """Mean path length of an unsuccessful search in a binary tree of n rows."""
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


class IsolationForest:
    """Random trees on subsamples; a path is longer where rows are many."""

    def __init__(self, x: np.ndarray, trees: int = TREES, psi: int = PSI, seed: int = 17, span: tuple[np.ndarray, np.ndarray] | None = None):
        rng = np.random.default_rng(seed)
        self.psi = min(psi, len(x))
        self.depth = max(1, int(np.ceil(np.log2(max(self.psi, 2)))))
        # What no good row shows at all can't be split on: a little spread below and above each column's range gives it paths of its own.
        self.lo, self.hi = span or (x.min(0), x.max(0))
        self.pad = np.maximum(0.1 * (self.hi - self.lo), 0.01)
        apart = rng.permutation(len(x))[: trees * psi].reshape(trees, psi) if len(x) >= trees * psi else [rng.choice(len(x), self.psi, replace=False) for _ in range(trees)]
        self.trees = [self._grow(x[rows], rng) for rows in apart]

    def _grow(self, x: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, ...]:
        """Arrays over a tree's nodes: column (or -1), split, left, right, path length."""
        nodes: list[tuple[int, float, int, int, float]] = []

        def grow(rows: np.ndarray, lo: np.ndarray, hi: np.ndarray, depth: int) -> int:
            me = len(nodes)
            nodes.append((-1, 0.0, 0, 0, depth + usual_path(len(rows))))
            if depth < self.depth and len(rows) > 1:
                c = int(rng.integers(x.shape[1]))
                at = rng.uniform(lo[c], hi[c])
                low = rows[:, c] < at
                left_hi, right_lo = hi.copy(), lo.copy()
                left_hi[c] = right_lo[c] = at
                a = grow(rows[low], lo, left_hi, depth + 1)
                b = grow(rows[~low], right_lo, hi, depth + 1)
                nodes[me] = (c, at, a, b, 0.0)
            return me

        grow(x, self.lo - self.pad, self.hi + self.pad, 0)
        return tuple(np.array(v) for v in zip(*nodes, strict=True))

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for column, split, left, right, path in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth + 1):
                c = column[at]
                inner = c >= 0
                if not inner.any():
                    break
                down = np.where(x[np.arange(len(x)), np.maximum(c, 0)] < split[at], left[at], right[at])
                at = np.where(inner, down, at)
            total += path[at]
        return 2.0 ** (-(total / len(self.trees)) / max(usual_path(self.psi), 1e-9))


def _span(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest features of all rows; one row of a task goes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [(x.min(0), x.max(0)) for x in (features(b.to_pandas()) for b in batches if b.num_rows)]
        if found:
            yield pa.RecordBatch.from_pydict({"lo": [np.min([x for x, _ in found], 0).tolist()], "hi": [np.max([x for _, x in found], 0).tolist()]})

    ends = map_batches(rows.select(*COUNTS), run, "lo array<double>, hi array<double>").collect()
    return np.min([r["lo"] for r in ends], 0), np.max([r["hi"] for r in ends], 0)


def score_cut(scored: DataFrame) -> float:
    """``threshold`` for anomaly scores of any number of rows (score, good): the score up to which rows are kept; inf without rows of both kinds.

    65,536 bins' counts go to the driver; inside a bin the cuts are tried by running sums."""
    counted = scored.groupBy("score").agg(F.count_if("good").alias("g"), F.count_if(~F.col("good")).alias("b")).withColumn("bin", F.floor(F.col("score") * 65536).cast("long"))
    by = materialize(counted, "rule-scores")
    bins = by.groupBy("bin").agg(F.sum("g").alias("g"), F.sum("b").alias("b"), F.max("score").alias("below")).toPandas().sort_values("bin", ascending=False)
    good, bad = int(bins["g"].sum()), int(bins["b"].sum())
    if not good or not bad:
        return float("inf")
    before = pd.DataFrame({"bin": bins["bin"], "g0": bins["g"].cumsum() - bins["g"], "b0": bins["b"].cumsum() - bins["b"], "below": bins["below"].shift(-1).fillna(-1.0)})
    down = Window.partitionBy("bin").orderBy(F.desc("score"))
    at = by.join(F.broadcast(scored.sparkSession.createDataFrame(before, "bin long, g0 long, b0 long, below double")), "bin")
    at = at.select("score", (F.sum("g").over(down) + F.col("g0")).alias("g"), (F.sum("b").over(down) + F.col("b0")).alias("b"), F.coalesce(F.lead("score").over(down), "below").alias("below"))
    value = F.lit(float(GOOD_WEIGHT)) * (F.lit(1.0) - F.col("g") / F.lit(good)) + F.col("b") / F.lit(bad)
    best = at.filter("below >= 0").agg(F.max(F.struct(value.alias("value"), "score", "below")).alias("x")).first()["x"]
    return float("inf") if best is None or best["value"] <= GOOD_WEIGHT else (best["score"] + best["below"]) / 2


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, n_words, the four base counts, base_failed, score (anomaly, in (0, 1)) and kept for each row of ``docs`` (doc_id, text).

    Base rules: fewer than 20 words, or more than 30 % of the words in 8-word
    windows that the text repeats.  Null and empty texts fail.  Without labelled
    rows of both qualities the forest gives no verdict (score 0) and the base
    rules decide.  Trees draw from all labelled good rows of one half by hash, ranges
    are theirs, and the threshold is fitted on all rows of the other half; of an id with
    two qualities the lower holds.  Other columns of ``docs`` are ignored.
    """
    rows = materialize(rule_statistics(docs), "rule-statistics")
    named = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).filter("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    named = materialize(named.select("doc_id", (F.col("quality") == 1).alias("good"), F.xxhash64("doc_id", F.lit(7)).alias("u")), "rule-labels")
    one = bounded_join(rows, named, ["doc_id"]).groupBy("doc_id", "good", "u").agg(F.min(F.struct(*COUNTS)).alias("x"))  # of rows that repeat an id, one
    known = materialize(one.select("doc_id", "good", "u", "x.*").filter(f"n_words >= {MIN_WORDS} and 100 * n_repeat_words <= {REPEAT_PERCENT} * n_words"), "rule-labelled")
    grown, forest, cut = known.filter("good and u % 2 = 0"), None, 0.0
    drawn = grown.orderBy("u", "doc_id").limit(TREES * PSI).toPandas()  # PSI for each tree, by hash of all rows
    if len(drawn) >= 2:
        forest = IsolationForest(features(drawn), span=_span(grown))
        given = docs.sparkSession.sparkContext.broadcast(forest)

        def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    yield pa.RecordBatch.from_arrays([pa.array(given.value.score(features(batch.to_pandas()))), batch.column(0)], ["score", "good"])

        cut = score_cut(map_batches(known.filter("u % 2 <> 0").select("good", *COUNTS), scores, "score double, good boolean"))
    shared = docs.sparkSession.sparkContext.broadcast((forest, cut))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, cut = shared.value
        for batch in batches:
            p = batch.to_pandas()
            score = forest.score(features(p)) if forest and len(p) else np.zeros(len(p))
            failed = ((p["n_words"] < MIN_WORDS) | (100 * p["n_repeat_words"] > REPEAT_PERCENT * p["n_words"])).to_numpy()
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(6)], pa.array(failed), pa.array(score), pa.array(~failed & ((score <= cut) | (forest is None)))], ["doc_id", *COUNTS[:5], "base_failed", "score", "kept"])

    return map_batches(rows, run, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS[:5]) + ", base_failed boolean, score double, kept boolean")
