"""Benchmark decontamination by size-partitioned MinHash containment search.

Test items are partitioned by the size of their shingle sets (powers of two).
An item's signature is its m least shingle hashes: a uniform sample of its set,
so the share of the signature that a document holds estimates how much of the
item the document contains, however long the document is.  Each partition has
a bound of its own: the signature hits that each of its items at the threshold
reaches but for a chance of 1e-6 (items of m shingles or fewer: exactly).
Candidates are then verified on whole shingle sets.

Items come to the documents in blocks of a bounded size, one after the other:
the documents are not shuffled, and the driver and every task hold one block's
index.  A benchmark of several blocks is searched in as many passes over the
documents, each of which is written before the next begins.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, bounded_join, map_batches, materialize, shingle_set, texts_of, window_hashes, words_of

SIGNATURE = 16
MISS = 1e-6
#: Characters of item text that one block sends to every task.
BLOCK_CHARS = 4_000_000


def hits_needed(size: int, percent: int, m: int = SIGNATURE, miss: float = MISS) -> int:
    """Signature hits of an item of ``size`` shingles of which ``percent`` % are in a document, but for a chance of ``miss``.

    The signature is a sample without replacement (hypergeometric)."""
    inside = ceil(size * percent / 100)
    if size <= m:
        return max(1, inside)
    total, below = comb(size, m), 0
    for c in range(m + 1):
        below += comb(inside, c) * comb(size - inside, m - c) if m - c <= size - inside else 0
        if below / total > miss:
            return max(1, c)
    return m


class ItemIndex:
    """Signatures and whole sets of one block of items."""

    def __init__(self, items: list[tuple[int, bytes]], percent: int, m: int = SIGNATURE, n: int = 5):
        self.percent, self.n = percent, n
        hashes = WordHashes()
        self.ids, self.sets = [], []
        for item, text in items:
            found = shingle_set(text, hashes, n)
            if len(found):
                self.ids.append(item)
                self.sets.append(found)
        #: One for each size class: signature values in order, their owners, and the hits that an owner needs.
        self.partitions = []
        sizes = np.array([len(s) for s in self.sets])
        for p in sorted({int(x).bit_length() for x in sizes}):
            own = [i for i, x in enumerate(sizes) if int(x).bit_length() == p]
            values = np.concatenate([self.sets[i][:m] for i in own])
            owners = np.concatenate([np.full(min(m, sizes[i]), i) for i in own])
            order = np.argsort(values, kind="stable")
            self.partitions.append((values[order], owners[order], min(hits_needed(int(x), percent, m) for x in {sizes[i] for i in own})))
        self.values = np.unique(np.concatenate([p[0] for p in self.partitions])) if self.partitions else np.empty(0, np.int64)

    def search(self, found: np.ndarray) -> list[tuple[int, int, int]]:
        """(item id, shingles, common shingles) of each item of which the set ``found`` holds enough."""
        out = []
        if not len(found) or not len(self.values):
            return out
        at = np.minimum(np.searchsorted(self.values, found), len(self.values) - 1)
        held = found[self.values[at] == found]  # most documents hold no signature value at all
        if not len(held):
            return out
        for values, owners, needed in self.partitions:
            at = np.minimum(np.searchsorted(held, values), len(held) - 1)
            own, hits = np.unique(owners[held[at] == values], return_counts=True)
            for i in own[hits >= needed]:
                whole = self.sets[i]
                common = len(np.intersect1d(whole, found, assume_unique=True))
                if 100 * common >= self.percent * len(whole):
                    out.append((self.ids[i], len(whole), common))
        return out


def contaminated(docs: DataFrame, benchmark: DataFrame, percent: int = 80, n: int = 5, m: int = SIGNATURE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, item_id, n_item, n_common for each row of ``docs`` that holds ``percent`` % of an item's distinct n-word shingles.

    An item with fewer than n words is one shingle, which only a text of the same
    words holds; items and texts without words match nothing.  Null ids stay null
    in the result; repeated rows give repeated results.  Columns other than doc_id
    and text (item_id and text) are ignored.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text is not null")
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-chars // block_chars))
    texts, out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), None
    for block in range(blocks):
        own = items if blocks == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        index = ItemIndex([(r[0], r[1].encode()) for r in own.toLocalIterator()], percent, m, n)
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            hashes = WordHashes()
            for batch in batches:
                rows: list[tuple] = []
                for doc, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), strict=True):
                    rows += [(doc, *x) for x in shared.value.search(np.unique(window_hashes(hashes.array(words_of(text)), n)))]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], ["doc_id", "item_id", "n_item", "n_common"])

        found = map_batches(texts, run, "doc_id long, item_id long, n_item long, n_common long")
        if blocks > 1:
            found = materialize(found, "contaminated")
            shared.destroy()
        out = found if out is None else out.union(found)
    return out


def decontaminated(docs: DataFrame, benchmark: DataFrame, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` whose doc_id has no contaminated text, with their columns; rows with a null doc_id stay."""
    leaks = materialize(contaminated(docs, benchmark, percent).select("doc_id").distinct(), "leaks")
    return bounded_join(docs, leaks, ["doc_id"], "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
