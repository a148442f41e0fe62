"""Line dedup with a log-template tree, DataFrame operations only.

A line goes down a tree of fixed depth: by its number of tokens, then by its
leading tokens (a token with a digit is a variable field).  In a leaf, a token
that enough documents have in its place is fixed and any other one is a variable
field; the line's template is its fixed tokens and fields.  A template of which
enough documents have a line, and whose tokens are mostly fixed, is recurring,
and its lines are dropped from every document.

A long line needs no variable field to be known again: one of more than
LONG_TOKENS tokens that two documents have word for word stays in the document
with the least id alone.

Leaves that too few documents reach are left at once, so what goes on is the
part of the lines that can recur.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, bounded_join, materialize

DEPTH = 3
MIN_DOCS = 10
#: A line of more tokens that recurs word for word is kept once, however few documents have it.
LONG_TOKENS = 50
#: Least share of a recurring template's tokens that are fixed, in percent.
FIXED_PERCENT = 60
FIELD = "<*>"


def tokens_of(line: Column) -> Column:
    """The words of a line; most lines have spaces alone, which split faster."""
    words = F.when(line.rlike(r"[\x09-\x0D]"), F.split(line, SPACES)).otherwise(F.split(line, " "))
    return F.array_remove(words, "")


def lines_of(docs: DataFrame) -> DataFrame:
    """doc, line_no, tokens and leaf of each line with a token; ``doc`` tells rows apart by id and text."""
    rows = docs.select(F.struct(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("text")).alias("doc"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    rows = rows.withColumn("tokens", tokens_of(F.col("line"))).filter(F.size("tokens") > 0)
    lead = F.transform(F.slice("tokens", 1, DEPTH), lambda t: F.when(t.rlike("[0-9]"), F.lit(FIELD)).otherwise(t))
    return rows.select("doc", "line_no", "tokens", F.xxhash64(F.size("tokens"), lead).alias("leaf"))


def long_repeats(lines: DataFrame) -> DataFrame:
    """doc and line_no of the long lines that a document with a lesser id has too; ``lines`` has doc, line_no, n and content."""
    long = lines.filter(F.col("n") > LONG_TOKENS).select("doc", "line_no", "content")
    first = materialize(long.groupBy("content").agg(F.min("doc.id").alias("first"), F.max("doc.id").alias("last")).filter("first < last").drop("last"), "line-long")
    return bounded_join(long, first, ["content"]).filter(F.col("doc.id") > F.col("first")).select("doc", "line_no")


def recurring_lines(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc and line_no of every line of a recurring template, and of long lines that recur word for word but for their first document's."""
    every = lines_of(docs)
    lines = materialize(every.select("doc", "line_no", "leaf", F.size("tokens").alias("n"), F.when(F.size("tokens") > LONG_TOKENS, F.xxhash64("leaf", "tokens")).alias("content")), "line-leaf")
    leaves = lines.select("leaf", F.col("doc.id").alias("id")).groupBy("leaf", "id").agg(F.lit(1).alias("one")).groupBy("leaf").agg(F.count(F.lit(1)).alias("docs")).filter(F.col("docs") >= min_docs).select("leaf")
    leaves = materialize(leaves, "line-leaves")
    found = materialize(bounded_join(every, leaves, ["leaf"], "left_semi").withColumn("content", F.xxhash64("leaf", "tokens")), "line-found")
    # A token's documents in its place; repeats within a document count once.
    placed = lambda df: df.select("leaf", "content", *[c for c in df.columns if c == "id"], F.posexplode("tokens").alias("pos", "token"))
    distinct = found.groupBy("leaf", "content").agg(F.first("tokens").alias("tokens"))
    holders = materialize(found.select("leaf", "content", F.col("doc.id").alias("id")).distinct(), "line-holders")
    texts = materialize(distinct, "line-contents")
    # A content that enough documents hold has all its tokens fixed; for other tokens the documents are counted over the other contents, each of few documents.
    held = materialize(holders.groupBy("leaf", "content").agg(F.count(F.lit(1)).alias("docs")), "line-held")
    common = placed(texts.join(held.filter(F.col("docs") >= min_docs), ["leaf", "content"], "left_semi")).select("leaf", "pos", "token").distinct()
    few = held.filter(F.col("docs") < min_docs).select("leaf", "content")
    spread = placed(texts.join(few, ["leaf", "content"], "left_semi")).join(holders.join(few, ["leaf", "content"], "left_semi"), ["leaf", "content"])
    counted = spread.groupBy("leaf", "pos", "token", "id").agg(F.lit(1).alias("one")).groupBy("leaf", "pos", "token").agg(F.count(F.lit(1)).alias("docs")).filter(F.col("docs") >= min_docs)
    fixed = common.union(counted.select("leaf", "pos", "token")).distinct().withColumn("fixed", F.lit(True))
    marked = placed(texts).join(fixed, ["leaf", "pos", "token"], "left")
    shown = F.when(F.coalesce("fixed", F.lit(False)) & ~F.col("token").rlike("[0-9]"), F.col("token")).otherwise(F.lit(FIELD))
    templates = marked.groupBy("leaf", "content").agg(F.sort_array(F.collect_list(F.struct("pos", shown.alias("token")))).alias("x"))
    templates = templates.select("leaf", "content", F.col("x.token").alias("x"))
    solid = F.size(F.filter("x", lambda t: t != FIELD)) * 100 >= F.size("x") * FIXED_PERCENT
    templates = materialize(templates.filter(solid).select("leaf", "content", F.xxhash64("leaf", "x").alias("template")), "line-templates")
    recurring = holders.join(templates, ["leaf", "content"]).groupBy("template", "id").agg(F.lit(1).alias("one")).groupBy("template").agg(F.count(F.lit(1)).alias("docs")).filter(F.col("docs") >= min_docs).select("template")
    contents = materialize(templates.join(recurring, "template", "left_semi").select("leaf", "content"), "line-recurring")
    dropped = bounded_join(found.select("doc", "line_no", "leaf", "content"), contents, ["leaf", "content"], "left_semi").select("doc", "line_no")
    return dropped.union(long_repeats(lines))


def deduplicated_lines(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc_id, text without the lines of recurring templates, n_lines and n_dropped, for each row of ``docs`` (doc_id, text).

    ``min_docs`` counts distinct ids, so rows that repeat an id count once and a
    null id not at all.  A null text stays null with 0 lines; an empty one has one
    line; lines without a token are kept; a text all of whose lines are dropped is
    empty.  Other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    drops = recurring_lines(docs.filter("doc_id is not null"), min_docs).distinct().groupBy("doc").agg(F.collect_list("line_no").alias("drop"))
    drops = materialize(drops, "line-drops").select(F.col("doc.id").alias("doc_id"), F.col("doc.text").alias("hash"), "drop")
    out = docs.withColumn("hash", F.xxhash64("text")).join(drops, ["doc_id", "hash"], "left")
    n = F.coalesce(F.size(F.split("text", "\n")), F.lit(0))
    n = F.when(F.col("text").isNull(), 0).otherwise(n).cast("long")
    keep = F.map_from_arrays(F.col("drop"), F.transform("drop", lambda x: F.lit(1)))
    lines = F.filter(F.split("text", "\n"), lambda x, i: F.col("keep")[i].isNull())
    out = out.withColumn("keep", F.when(F.col("drop").isNotNull(), keep))
    text = F.when(F.col("drop").isNull(), F.col("text")).otherwise(F.array_join(lines, "\n"))
    return out.select("doc_id", text.alias("text"), n.alias("n_lines"), F.coalesce(F.size("drop"), F.lit(0)).cast("long").alias("n_dropped_raw")).select("doc_id", "text", "n_lines", F.greatest("n_dropped_raw", F.lit(0)).cast("long").alias("n_dropped"))
