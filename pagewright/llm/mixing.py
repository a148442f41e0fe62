"""Mixing sources to target weights by Pareto order sampling, DataFrame operations only.

A source whose target is r times its size takes floor(r) whole copies of each
document and a sample of about (r - floor(r)) of its words.  The sample is of
unequal probability: a document's inclusion probability p falls with the length
class (binary digits of its number of words) that it is in, so that the same
words come from more documents, and is scaled by source such that the expected
words are those still missing; classes that this would take above 1 are certain
and the rest is scaled again.  Documents are ordered by random odds over
inclusion odds, (U / (1 - U)) / (p / (1 - p)) with U uniform from the document
id, and the first ones are taken up to the number of words still missing, to the
nearer side of the document that crosses it: a source's taken words differ from
its target by half of that document's words at most.

No source is gathered in one task: the cut is found on two histograms of the
order (256 bins each, pre-aggregated) and then among the documents of one bin
of the second.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, SPACES, bounded_join, free, materialize, uniform

#: Weights by rank of the source's name, repeating.
WEIGHTS = (5, 2, 1)
MAX_COPIES = 3
BINS = 256
#: A document's share of inclusion is this less the binary digits of its number of words, 1 at least.
MOST_DIGITS = 17
SEED = "mix"


def n_words(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.size(F.array_remove(F.split(text, SPACES), "")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MAX_COPIES) -> DataFrame:
    """source, source_size -> also target: shares of the total by weight, none above ``most`` times its size.

    The excess goes to the others by weight until none is above, which fills
    levels: with sources in order of most * size / weight, the capped ones are
    a prefix.  One row for each source.  A source of size 0 has target 0.
    """
    cycle = F.array(*[F.lit(w) for w in weights])
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    out = sizes.withColumn("w", F.element_at(cycle, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")).cast("long"))
    by_cap = Window.orderBy((F.col("source_size").cast("double") * most / F.col("w")).asc(), F.col("source").asc_nulls_last())
    before, rest = by_cap.rowsBetween(Window.unboundedPreceding, -1), by_cap.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    out = (
        out.withColumn("open", F.sum("source_size").over(everything) - F.coalesce(F.sum("source_size").over(before), F.lit(0)) * most)
        .withColumn("rest_w", F.sum("w").over(rest))
        .withColumn("capped", F.col("source_size") * most * F.col("rest_w") <= F.col("open") * F.col("w"))
    )
    # Behind the capped prefix all share one level; it is that of the first source which is not capped.
    first = F.min(F.when(~F.col("capped"), F.struct((-F.col("rest_w")).alias("order"), F.col("open").alias("open"), F.col("rest_w").alias("rest_w")))).over(everything)
    level = out.withColumn("level", first)
    target = F.when(F.col("capped"), (F.col("source_size") * most).cast("double")).otherwise((F.col("level.open") * F.col("w")).cast("double") / F.col("level.rest_w"))
    return level.select("source", "source_size", target.alias("target"))


def _plan(slim: DataFrame, goals: DataFrame, most: int) -> DataFrame:
    """source -> copies (whole), need (words of the sample) and key (the source, never null)."""
    ratio = F.col("target") / F.col("source_size")
    goals = goals.withColumn("copies", F.when(F.col("source_size") > 0, F.least(F.floor(ratio), F.lit(most))).otherwise(0).cast("long"))
    goals = goals.withColumn("need", F.greatest(F.col("target") - F.col("copies") * F.col("source_size"), F.lit(0.0)))
    return goals.withColumn("key", F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")))


def inclusion(rows: DataFrame, goals: DataFrame) -> DataFrame:
    """key, cls and p of each source's length classes; ``rows`` has key, cls and size.  At most 64 rows for each source."""
    sums = rows.filter("size > 0").groupBy("key", "cls").agg(F.sum("size").alias("words")).withColumn("h", F.greatest(F.lit(MOST_DIGITS) - F.col("cls"), F.lit(1)).cast("long"))
    by_class, of_source = Window.partitionBy("key").orderBy("cls"), Window.partitionBy("key")
    sums = bounded_join(sums, goals.select("key", "need"), ["key"])
    left = F.col("need") - F.coalesce(F.sum("words").over(by_class.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.withColumn("left", left).withColumn("rest", F.sum(F.col("words") * F.col("h")).over(by_class.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    # The certain classes come first; all others share the scale of the first of them.
    sums = sums.withColumn("certain", F.col("left") * F.col("h") >= F.col("rest")).withColumn("scale", F.col("left") / F.col("rest"))
    sums = sums.withColumn("scale", F.min(F.when(~F.col("certain"), F.struct("cls", "scale"))).over(of_source)["scale"])
    return sums.select("key", "cls", F.when(F.col("certain"), 1.0).otherwise(F.col("scale") * F.col("h")).alias("p"))


def order_key(p: Column, seed: str = SEED, on: str = "doc_id") -> Column:
    """Random odds over inclusion odds; 0 for what is certain, null for what is never taken."""
    u = uniform(F.col(on), seed)
    return F.when(p >= 1, F.lit(0.0)).when(p > 0, (u / (1 - u)) / (p / (1 - p)))


def _bin(q: Column, bins: int) -> Column:
    return F.floor(q / (1 + q) * bins).cast("long")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MAX_COPIES, seed: str = SEED, sizes: DataFrame | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target, taken (words, repeats counted) and copies for each row of ``docs``.

    Reads doc_id, text and source; other columns are ignored.  A null source is
    a source of its own, named last; null and empty texts have size 0 and are
    never taken; rows that repeat an id share its random number, so a tie is
    taken or left as a whole.  Targets are worked out on one row for each source.
    Also returns p, the inclusion probability beyond the whole copies.
    """
    slim = sizes if sizes is not None else materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), n_words(F.col("text")).alias("size")), "mix-sizes")
    goals = materialize(_plan(slim, targets(slim.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most), most), "mix-goals")
    keyed = slim.withColumn("key", F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))).drop("source").withColumn("cls", F.length(F.bin("size")))
    shares = materialize(inclusion(keyed, goals), "mix-inclusion")
    rows = bounded_join(bounded_join(keyed, goals, ["key"]), shares, ["key", "cls"], "left").withColumn("q", order_key(F.col("p"), seed))

    def narrowed(rows: DataFrame, bins: int) -> DataFrame:
        """key -> bin of the cut and words before it, by a running sum over at most BINS rows for each source."""
        sums = rows.groupBy("key", _bin(F.col("q"), bins).alias("bin")).agg(F.sum("size").alias("words"), F.first("need").alias("need"), F.first("base").alias("base"))
        upto = F.sum("words").over(Window.partitionBy("key").orderBy("bin")) + F.col("base")
        return sums.withColumn("upto", upto).filter(F.col("upto") >= F.col("need")).groupBy("key").agg(F.min(F.struct("bin", (F.col("upto") - F.col("words")).alias("words"))).alias("at")).select("key", F.col("at.bin").alias("bin"), F.col("at.words").alias("base"))

    one = materialize(narrowed(rows.filter("q is not null").withColumn("base", F.lit(0).cast("long")), BINS), "mix-bins")
    inside = bounded_join(rows.filter("q is not null").withColumn("bin", _bin(F.col("q"), BINS)), one, ["key", "bin"]).drop("bin")
    two = materialize(narrowed(inside, BINS * BINS), "mix-bins")
    last = bounded_join(inside.drop("base").withColumn("bin", _bin(F.col("q"), BINS * BINS)), two, ["key", "bin"])
    ties = last.groupBy("key", "q").agg(F.sum("size").alias("words"), F.first("need").alias("need"), F.first("base").alias("base"))
    upto = F.sum("words").over(Window.partitionBy("key").orderBy("q")) + F.col("base")
    # Taken up to the crossing order, or without it where that is nearer; one bin holds a 65536th of a source.
    near = ties.withColumn("upto", upto).withColumn("over", F.col("upto") - F.col("need")).withColumn("under", F.col("need") - (F.col("upto") - F.col("words")))
    cuts = near.filter((F.col("upto") >= F.col("need"))).groupBy("key").agg(F.min(F.struct("q", "over", "under")).alias("at"))
    cuts = materialize(cuts.select("key", F.col("at.q").alias("cut"), (F.col("at.over") <= F.col("at.under")).alias("with_cut")), "mix-cuts")
    out = bounded_join(rows, cuts, ["key"], "left")
    taken = F.coalesce(F.when(F.col("with_cut"), F.col("q") <= F.col("cut")).otherwise(F.col("q") < F.col("cut")), F.lit(False))
    copies = F.when(F.col("size") > 0, F.col("copies") + taken.cast("long")).otherwise(0)
    return out.select("doc_id", "source", "size", "source_size", "target", (copies * F.col("size")).alias("taken"), copies.alias("copies"), F.coalesce(F.col("p"), F.lit(0.0)).alias("p"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents themselves, each as often as the mix takes it, with the columns of ``docs``.

    Rows that repeat an id have one random number and one source, hence the same copies."""
    i, source, copies, n = (free(docs, x) for x in ("mix_id", "mix_source", "mix_copies", "mix_n"))
    taken = mix(docs, **options).filter("copies > 0").select(F.col("doc_id").alias(i), F.col("source").alias(source), F.col("copies").alias(copies))
    plan = materialize(taken.distinct(), "mix-copies")
    small = plan.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    # Null ids and sources match each other; texts without words are never taken.
    left = docs.filter(n_words(F.col("text")) > 0)
    joined = left.join(F.broadcast(plan) if small else plan, left["doc_id"].cast("long").eqNullSafe(plan[i]) & left["source"].eqNullSafe(plan[source]))
    return joined.withColumn(n, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies)))).select(*[F.col(f"`{c}`") for c in docs.columns])
