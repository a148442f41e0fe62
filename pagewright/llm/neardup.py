"""Near-duplicate detection with bottom-k MinHash sketches from one hash function.

1. Each text's shingle set is hashed; rows with equal sets form a class, which
   goes on as one node named by its least doc_id.
2. A node's sketch is its k least hashes.  Two sets of Jaccard similarity J have
   in common about Binomial(k, J) of the k least hashes of their union, so a pair
   at the threshold shares ``need`` values but for a chance of 1e-6; such a pair
   meets in the ``k - need + 1`` rarest values of each (prefix filter).  The
   inverted lists hold those values alone, which leaves out the values that a
   passage common to many texts brings.
3. In rounds, members of a list meet its most central node (whose values are the
   most shared), candidates are estimated on the sketch of the union and verified
   on the whole sets, and verified links merge components.  Lists whose members
   are all in one component are done, so a large group costs a few links for each
   member and not a pair for each two.  What is left after the rounds is compared
   across components, where exact bounds on whole sets leave a pair possible.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, comb

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, bounded_join, map_batches, materialize, shingle_set, texts_of

SKETCH = 32
MISS = 1e-6
#: Rounds in which list members meet the list's most central node; in the last one, whole sets say which that is.
STAR_ROUNDS = 2


def least_overlap(k: int, similarity: float, miss: float = MISS) -> int:
    """The number of shared sketch values that a pair at the threshold reaches but for a chance of ``miss``."""
    below = 0.0
    for c in range(k + 1):
        below += comb(k, c) * similarity**c * (1 - similarity) ** (k - c)
        if below > miss:
            return max(1, c)
    return k


def sketches(docs: DataFrame, k: int = SKETCH, n: int = 5) -> DataFrame:
    """doc_id, n_shingles, cls (a 128-bit digest of the shingle set) and sketch, for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            counts, classes, kept = [], [], []
            for text in texts_of(batch.column(1)):
                found = shingle_set(text, hashes, n)
                counts.append(len(found))
                classes.append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
                kept.append(found[:k])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(classes, pa.binary()), pa.array(kept, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "cls", "sketch"])

    return map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, n_shingles long, cls binary, sketch array<long>")


def shingle_sets(docs: DataFrame, n: int = 5) -> DataFrame:
    """node (the row's doc_id) and its whole shingle set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingle_set(t, hashes, n) for t in texts_of(batch.column(1))], pa.list_(pa.int64()))], ["node", "shingles"])

    return map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "node long, shingles array<long>")


def components(edges: DataFrame) -> DataFrame:
    """node, comp: the least node of each node's connected component.  ``edges`` has columns a, b.

    Each step takes every component to its least neighbour, follows that pointer
    twice and contracts the edges; each edge's ends merge in the end, and the
    number of steps is logarithmic in a component's size.
    """
    labels = materialize(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("comp", F.col("node")), "cc-labels")
    left = materialize(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "cc-edges")
    while not left.isEmpty():
        both = left.union(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = materialize(both.groupBy("a").agg(F.min("b").alias("p")).select(F.col("a").alias("comp"), F.least("a", "p").alias("p")), "cc-parent")
        for _ in range(2):
            up = parent.select(F.col("comp").alias("p"), F.col("p").alias("q"))
            parent = parent.join(up, "p").select("comp", F.col("q").alias("p"))
        parent = materialize(parent, "cc-parent")
        labels = materialize(labels.join(parent, "comp", "left").select("node", F.coalesce("p", "comp").alias("comp")), "cc-labels")
        to = parent.select(F.col("comp").alias("a"), F.col("p").alias("pa"))
        to_b = parent.select(F.col("comp").alias("b"), F.col("p").alias("pb"))
        left = materialize(left.join(to, "a").join(to_b, "b").filter("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "cc-edges")
    return labels


def estimate(a: Column, b: Column, k: int) -> Column:
    """Share of the k least values of the union that both sketches hold."""
    union = F.slice(F.array_sort(F.array_union(a, b)), 1, k)
    return F.size(F.array_intersect(union, F.array_intersect(a, b))) / F.size(union)


class NearDuplicates:
    """The search over one table; see the module's text for the method."""

    def __init__(self, docs: DataFrame, percent: int, k: int = SKETCH, n: int = 5):
        self.docs, self.percent, self.k, self.n = docs, percent, k, n
        self.need = least_overlap(k, percent / 100)
        self.floor = max(0.0, self.need / k - 1e-9)
        self.rows = materialize(sketches(docs, k, n), "dup-sketches")

    def classes(self) -> DataFrame:
        """cls, node, n, sketch: one row for each distinct shingle set."""
        there = self.rows.filter("cls is not null and doc_id is not null")
        least = there.groupBy("cls").agg(F.min("doc_id").alias("doc_id"))
        return there.join(least, ["cls", "doc_id"], "left_semi").dropDuplicates(["cls", "doc_id"]).select("cls", F.col("doc_id").alias("node"), F.col("n_shingles").alias("n"), "sketch")

    def lists(self, nodes: DataFrame) -> DataFrame:
        """v, node, n, central: the prefix postings whose value two nodes or more hold."""
        posts = nodes.select("node", "n", F.size("sketch").alias("s"), F.explode("sketch").alias("v"))
        df = posts.groupBy("v").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
        shared = posts.join(df, "v").groupBy("node", "n", "s").agg(F.array_sort(F.collect_list(F.struct("df", "v"))).alias("vs"))
        need = F.when(F.col("s") == self.k, F.lit(self.need)).otherwise(F.least(F.ceil(F.col("s") * self.percent / 100).cast("int"), F.lit(self.need)))
        prefix = F.col("s") - need + 1 - (F.col("s") - F.size("vs"))  # values that no other node holds come first
        central = F.aggregate("vs", F.lit(0).cast("long"), lambda x, y: x + F.least(y["df"], F.lit(1_000_000)))
        picked = shared.withColumn("central", central).filter(prefix > 0).withColumn("vs", F.slice("vs", F.lit(1), F.greatest(prefix, F.lit(1))))
        return picked.select("node", "n", "central", F.explode("vs").alias("x")).select("node", "n", "central", F.col("x.v").alias("v"))

    def verified(self, pairs: DataFrame, nodes: DataFrame, best: bool) -> DataFrame:
        """The pairs (a, b) that reach the threshold on whole sets; with ``best``, of each b's candidates two are tried: the best estimate, and the most central one (w)."""
        side = lambda x: nodes.select(F.col("node").alias(x), F.col("sketch").alias(f"s{x}"), F.col("n").alias(f"n{x}"))
        found = pairs.join(side("b"), "b").join(side("a"), "a").withColumn("e", estimate(F.col("sa"), F.col("sb"), self.k))
        found = found.filter(F.col("e") >= self.floor).filter(100 * F.least("na", "nb") >= self.percent * F.greatest("na", "nb"))
        if best:
            found = found.groupBy("b").agg(F.array(F.max(F.struct("e", "a"))["a"], F.max(F.struct("w", "a"))["a"]).alias("x")).select(F.explode("x").alias("a"), "b")
        found = materialize(found.select("a", "b").distinct(), "dup-candidates")
        if found.isEmpty():
            return found
        wanted = materialize(found.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "dup-wanted")
        # Rows that repeat an id are one node, and any of their sets may be the one that links.
        sets = shingle_sets(bounded_join(self.docs.select("doc_id", "text"), wanted, ["doc_id"]), self.n)
        sets = materialize(sets, "dup-sets")
        full = lambda x: sets.select(F.col("node").alias(x), F.col("shingles").alias(f"f{x}"))
        tried = found.join(full("b"), "b").join(full("a"), "a")
        both = F.size(F.array_intersect("fa", "fb"))
        tried = tried.select("a", "b", both.alias("both"), (F.size("fa") + F.size("fb") - both).alias("either"))
        return tried.filter(100 * F.col("both") >= self.percent * F.col("either")).select("a", "b").distinct()

    def postings(self, members: DataFrame) -> tuple[DataFrame, DataFrame]:
        """node, cls, size, g: the members' whole sets; and g, df: the shingles that two sets or more hold."""
        wanted = materialize(members.select(F.col("node").alias("doc_id")).distinct(), "dup-members")
        sets = shingle_sets(bounded_join(self.docs.select("doc_id", "text"), wanted, ["doc_id"]), self.n)
        sets = materialize(sets.withColumn("size", F.size("shingles")).withColumn("cls", F.xxhash64("shingles")), "dup-member-sets")
        posts = sets.select("node", "cls", "size", F.explode("shingles").alias("g"))
        return posts, posts.groupBy("g").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")

    def weighed(self, at: DataFrame, open_lists: DataFrame) -> DataFrame:
        """The members of open lists, with the centrality of their whole sets for that of their sketches, in which a
        group's centre and copies with few edits are the same."""
        at = materialize(at.join(open_lists.select("v"), "v", "left_semi"), "dup-open")
        posts, shared = self.postings(at)
        whole = posts.join(shared, "g").groupBy("node").agg(F.sum(F.least("df", F.lit(1_000_000))).alias("whole"))
        return at.drop("central").join(materialize(whole, "dup-whole"), "node", "left").withColumn("central", F.coalesce("whole", F.lit(0)))

    def bounded_pairs(self, members: DataFrame) -> DataFrame:
        """a, b: the pairs of list members across components that can still reach the threshold, by bounds on whole sets.

        ``members`` has v, node, n, comp, and ca, the component of the list's most central node; one of a pair is
        outside ca.  Shingles are put in one order, the rarest among the members first.  If the first shingle that two
        sets share stands at i in one and at j in the other, they have at most ``min(n - i, m - j)`` in common, so only
        the rare end of each set is compared.  A copy's own edits come first in its order: copies with edits of their
        own meet those with like edits, and not the rest of their group."""
        p, (posts, shared) = self.percent, self.postings(members)
        ends = posts.join(shared, "g").groupBy("node", "cls", "size").agg(F.array_sort(F.collect_list(F.struct("df", "g"))).alias("gs"))
        ends = ends.select("node", "size", (F.col("size") - F.size("gs")).alias("alone"), F.posexplode("gs").alias("at", "x"))
        # Of what it has, a set shares p percent at least.
        ends = ends.withColumn("left", F.col("size") - F.col("alone") - F.col("at")).filter(100 * F.col("left") >= p * F.col("size"))
        ends = ends.select("node", "size", "left", F.col("x.g").alias("g")).join(members.select("node", "comp").distinct(), "node")
        ends = materialize(ends, "dup-ends")
        one = ends.join(members.filter("comp <> ca").select("node").distinct(), "node", "left_semi")
        one = one.select("g", F.col("node").alias("x"), F.col("size").alias("nx"), F.col("left").alias("lx"), F.col("comp").alias("cx"))
        near = (F.col("comp") != F.col("cx")) & ((100 + p) * F.least("left", "lx") >= p * (F.col("size") + F.col("nx")))
        return one.join(ends, "g").filter(near).select(F.least("x", "node").alias("a"), F.greatest("x", "node").alias("b")).distinct()

    def links(self, nodes: DataFrame) -> DataFrame:
        lists = materialize(self.lists(nodes), "dup-lists")
        tops_of = lambda at: at.groupBy("v").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max(F.struct("central", "n", "node", "comp")).alias("top")).filter("lo <> hi")
        edges, labels, r = None, None, 0
        while True:
            at = lists.withColumn("comp", F.col("node")) if labels is None else lists.join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
            open_lists = tops_of(at)
            r += 1
            if r == STAR_ROUNDS:
                at = materialize(self.weighed(at, open_lists), "dup-weighed")
                open_lists = tops_of(at)
            if r <= STAR_ROUNDS:
                # Members of another component than the list's most central node are tried against it: first by sketches, then by whole sets.
                tops = open_lists.select("v", F.col("top.node").alias("a"), F.col("top.central").alias("w"), F.col("top.comp").alias("ca"))
                pairs = at.join(tops, "v").filter("comp <> ca").select("a", "w", F.col("node").alias("b")).distinct()
            else:
                # All pairs across components that the bounds on whole sets leave.
                tops = open_lists.select("v", F.col("top.comp").alias("ca"))
                members = materialize(at.join(tops, "v"), "dup-open")
                if members.isEmpty():
                    return labels
                pairs = self.bounded_pairs(members)
            new = materialize(self.verified(pairs, nodes, r <= STAR_ROUNDS), "dup-links")
            if not new.isEmpty():
                edges = new if edges is None else edges.union(new)
                labels = components(edges)
            if r > STAR_ROUNDS:
                return labels

    def groups(self) -> DataFrame:
        """doc_id, n_shingles, component_id and kept for each row."""
        nodes = materialize(self.classes(), "dup-nodes")
        labels = self.links(nodes)
        # A class's rows take its node's component; rows that repeat an id hold their classes together.
        named = self.rows.filter("cls is not null and doc_id is not null").select("cls", "doc_id")
        classes = nodes.select("cls", "node")
        if labels is not None:
            classes = classes.join(labels, "node", "left").select("cls", F.coalesce("comp", "node").alias("node"))
        one = named.groupBy("doc_id").agg(F.min("cls").alias("x"), F.max("cls").alias("y")).filter("x <> y").select("doc_id")
        if not one.isEmpty():
            ties = named.join(one, "doc_id").join(classes, "cls").select(F.col("doc_id").alias("a"), F.col("node").alias("b")).distinct()
            merged = components(ties)
            classes = classes.join(merged, "node", "left").select("cls", F.coalesce("comp", "node").alias("node"))
        out = self.rows.select("doc_id", "n_shingles", "cls").join(classes.withColumnRenamed("node", "component_id"), "cls", "left")
        component = F.coalesce(F.col("component_id"), F.col("doc_id"))
        return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def near_duplicates(docs: DataFrame, percent: int = 80, k: int = SKETCH, n: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id of the group) and kept for each row of ``docs`` (doc_id, text).

    Rows without words are linked with nothing.  Rows that repeat a doc_id are
    one document with each of their texts, so they share a component and their
    fate.  A null doc_id is linked with nothing, has a null component and is
    kept.  An empty table gives an empty result.
    """
    return NearDuplicates(docs, percent, k, n).groups()


def deduplicated(docs: DataFrame, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that are the least of their group, with their columns."""
    out = materialize(near_duplicates(docs, percent).filter("not kept").select("doc_id").distinct(), "dup-dropped")
    return bounded_join(docs, out, ["doc_id"], "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
