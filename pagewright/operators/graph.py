"""Connected components inside pages."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

#: So many edges, when no more are left, are followed on the driver.
MOST_LOCAL = 500_000


def _local(edges: DataFrame) -> DataFrame:
    """page_id, root and p (the least node it is linked to) of the nodes of few edges."""
    found = edges.select("page_id", "a", "b").dropna().toArrow()
    page, pages = pd.factorize(found["page_id"].to_pandas())
    node, nodes = pd.factorize(pd.concat([found["a"].to_pandas(), found["b"].to_pandas()]), sort=True)
    known, at = np.unique(np.concatenate([page, page]) * max(len(nodes), 1) + node, return_inverse=True)  # in a page by node
    a, b = at[: len(page)], at[len(page) :]
    up = np.arange(len(known))
    while len(a):
        np.minimum.at(up, np.maximum(a, b), np.minimum(a, b))
        while (up != up[up]).any():
            up = up[up]
        a, b = up[a], up[b]
        a, b = a[a != b], b[a != b]
    of = lambda i: pa.array(nodes[known[i] % max(len(nodes), 1)], found.schema.field("a").type)
    rows = pa.table({"page_id": pa.array(pages[known // max(len(nodes), 1)], found.schema.field("page_id").type), "root": of(np.arange(len(known))), "p": of(up)})
    fields = edges.dtypes
    return edges.sparkSession.createDataFrame(rows, f"page_id {fields[0][1]}, root {fields[1][1]}, p {fields[1][1]}")


def components(edges: DataFrame) -> DataFrame:
    """page_id, node and root (the least node of its component) for the nodes of ``edges`` (page_id, a, b).

    Each step hooks every node to its neighbour of least hash, follows the pointers twice and contracts the edges; a node is
    the least of its neighbours by chance, so a chain in order is no worse than others and a graph of n nodes takes about
    log n steps.  The last MOST_LOCAL edges go to the driver.  Joins are merged: what a step knows of its sizes is a guess."""
    left = every = cut(edges.select("page_id", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    steps: list[DataFrame] = []
    while left.filter("a <> b").limit(MOST_LOCAL + 1).count() > MOST_LOCAL:
        ranked = lambda c: F.struct(F.xxhash64("page_id", c, F.lit(len(steps))).alias("h"), F.col(c).alias("node"))  # noqa: B023, E731
        both = left.union(left.select("page_id", F.col("b").alias("a"), F.col("a").alias("b"))).withColumn("b", ranked("b"))
        parent = cut(both.groupBy("page_id", "a").agg(F.min("b").alias("b")).select("page_id", F.col("a").alias("root"), F.least("b", ranked("a"))["node"].alias("p")))
        ends = parent.select("page_id", F.col("root").alias("p"), F.col("p").alias("q")).hint("merge")
        for _ in range(2):
            parent = parent.join(ends, ["page_id", "p"]).select("page_id", "root", F.col("q").alias("p"))
        parent = cut(parent)
        steps.append(parent)
        for side in ("a", "b"):
            left = left.join(parent.select("page_id", F.col("root").alias(side), F.col("p").alias(f"p{side}")).hint("merge"), ["page_id", side])
        left = cut(left.filter("pa <> pb").select("page_id", F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct())
    found = _local(left)
    if not steps:
        return every.select("page_id", F.explode(F.array("a", "b")).alias("root")).distinct().join(found, ["page_id", "root"], "left").select("page_id", F.col("root").alias("node"), F.coalesce("p", "root").alias("root"))
    for parent in reversed(steps):
        found = parent.join(found.select("page_id", F.col("root").alias("p"), F.col("p").alias("q")).hint("merge"), ["page_id", "p"], "left").select("page_id", "root", F.coalesce("q", "p").alias("p"))
    found = cut(found)
    least = found.groupBy("page_id", "p").agg(F.min("root").alias("least"))
    return found.join(least.hint("merge"), ["page_id", "p"]).select("page_id", F.col("root").alias("node"), F.col("least").alias("root"))
