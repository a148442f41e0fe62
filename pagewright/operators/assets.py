"""Asset relations: merging candidates, size variants, ranking, sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules
from . import graph


def merge_candidates(candidates: DataFrame) -> DataFrame:
    """One record for each (page_id, url): first-seen places, least order, any/all flags, largest sizes, first label, uses."""
    area = F.coalesce(F.col("natural_w") * F.col("natural_h"), F.lit(0.0))
    # First by place, of which there are few kinds, and by element: what is collected for a URL is bounded.
    facts = {
        "ord": F.min("ord"), "visible": F.max("visible"), "declared_only": F.min("declared_only"), "descriptor_w": F.max("descriptor_w"), "logo_score": F.max("logo_score"),
        "natural": F.max(F.struct(area.alias("area"), (-F.col("ord")).alias("at"), "natural_w", "natural_h")), "first": F.min(F.when(F.col("label").isNotNull(), F.struct("ord", "label"))),
    }
    by_place = candidates.groupBy("page_id", "url", "found_in").agg(*[f.alias(name) for name, f in facts.items()])
    again = {"ord": F.min, "declared_only": F.min, "first": F.min}
    merged = by_place.groupBy("page_id", "url").agg(F.array_sort(F.collect_list(F.struct("ord", "found_in"))).alias("places"), *[again.get(name, F.max)(name).alias(name) for name in facts])
    uses = candidates.filter("grp is not null").select("page_id", "url", "grp").distinct().groupBy("page_id", "url").agg(F.count(F.lit(1)).alias("used_count"))
    grouped = merged.join(uses, ["page_id", "url"], "left").withColumn("used_count", F.coalesce("used_count", F.lit(0))).withColumn("label", F.col("first.label"))
    return grouped.select("page_id", "url", F.array_join(F.transform("places", lambda x: x["found_in"]), ",").alias("found_in"), "ord", "visible", "declared_only", "descriptor_w", F.col("natural.natural_w").alias("natural_w"), F.col("natural.natural_h").alias("natural_h"), "label", "logo_score", "used_count")


def with_captures(records: DataFrame, captures: DataFrame) -> DataFrame:
    """Records with what the network captured of them, and captured images without a candidate behind them."""
    good = captures.filter((F.col("status") >= 200) & (F.col("status") < 400))
    joined = records.join(captures, ["page_id", "url"], "left").withColumn("source", F.lit("candidate"))
    return joined.unionByName(good.join(records, ["page_id", "url"], "left_anti").withColumn("source", F.lit("network")), allowMissingColumns=True)


def counted_noise(records: DataFrame, reason: Column) -> DataFrame:
    """page_id, reason and n of the hidden records; a record without a reason counts as kept."""
    return records.withColumn("reason", F.coalesce(reason, F.lit("kept"))).groupBy("page_id", "reason").agg(F.count(F.lit(1)).alias("n"))


def implicit_favicons(pages: DataFrame, icons: DataFrame) -> DataFrame:
    """/favicon.ico of the pages that name no icon."""
    origin = F.regexp_extract("url", r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    return pages.join(icons.select("page_id"), "page_id", "left_anti").select("page_id", F.concat(origin, F.lit("/favicon.ico")).alias("url"))


def variant_groups(members: DataFrame) -> DataFrame:
    """page_id, idx, root (the least member it is linked to) and group_kind: members linked by an element group, a variant key or a content hash, split by kind.

    ``members`` has groups (element groups in order), preferred_group, art_directed, variant_key and sha1.  A member
    of several element groups joins its preferred one alone (the first one where none is), and an art-directed one joins
    none.  Each key's members are linked to its least one, so there are no pairs."""
    several = F.size("groups") > 1
    group = F.when(~F.coalesce("art_directed", F.lit(False)) & (F.size("groups") > 0), F.when(several, F.coalesce("preferred_group", F.col("groups")[0])).otherwise(F.col("groups")[0]))
    key = lambda kind, value: F.when(value.isNotNull(), F.concat(F.lit(f"{kind}:"), value.cast("string")))
    keys = members.select("page_id", "idx", F.explode(F.array_compact(F.array(key("group", group), key("variant", F.col("variant_key")), key("content", F.col("sha1"))))).alias("key"))
    least = keys.groupBy("page_id", "key").agg(F.min("idx").alias("b"))
    roots = graph.components(keys.join(least.hint("merge"), ["page_id", "key"]).select("page_id", F.col("idx").alias("a"), "b"))
    return members.select("page_id", "idx", "kind").join(roots.withColumnRenamed("node", "idx").hint("merge"), ["page_id", "idx"], "left").select("page_id", "idx", F.coalesce("root", "idx").alias("root"), F.col("kind").alias("group_kind"))


def best_members(members: DataFrame, groups: DataFrame) -> DataFrame:
    """page_id, root, group_kind, best (greatest size score, first on a tie) and members of each group."""
    return members.join(groups.hint("merge"), ["page_id", "idx"]).groupBy("page_id", "root", "group_kind").agg(F.max_by("idx", F.struct(F.col("size_score"), -F.col("idx"))).alias("best"), F.count(F.lit(1)).alias("members"))


def ranked(assets: DataFrame) -> DataFrame:
    """rank by relevance and index within the kind in page order."""
    page = Window.partitionBy("page_id")
    return assets.withColumn("rank", F.row_number().over(page.orderBy(F.desc("score"), "ord", "id")).cast("long")).withColumn("kind_index", F.row_number().over(Window.partitionBy("page_id", "kind").orderBy("ord", "id")).cast("long"))


SECTIONS = ("logos", "svg", "images", "small-icons", "stylesheets")


def sort_keys(sort: str) -> list[Column]:
    last = [F.desc("score"), F.asc("ord"), F.asc("id")]
    if sort == "page-order":
        return [F.asc("ord"), F.asc("id")]
    first = {"relevance": [], "largest": [F.desc(F.col("width") * F.col("height"))], "file-size": [F.desc(F.coalesce("bytes", F.lit(-1)))], "name": [natural_key(F.col("name")).asc()]}[sort]
    return first + last


def natural_key(name: Column) -> Column:
    """Orders digits by value: each run of digits is padded to 12."""
    runs = F.regexp_extract_all(F.lower(name), F.lit("([0-9]+|[^0-9]+)"), 1)
    return F.array_join(F.transform(runs, lambda r: F.when(r.rlike("^[0-9]"), F.lpad(r, 12, "0")).otherwise(r)), "")


def section_of(tab: str = "all") -> Column:
    logos = F.col("role").isin("site-logo", "logo", "favicon")
    small = rules.small_icon(F.col("role"), F.col("rendered_w"), F.col("rendered_h"), F.col("width"), F.col("height"))
    rest = F.when(F.col("declared_only"), "stylesheets").when(small, "small-icons").when(F.col("kind") == "svg", "svg").otherwise("images")
    return F.when(logos, "logos").otherwise(rest) if tab == "all" else rest


def searched(assets: DataFrame, query: str) -> DataFrame:
    """Case-insensitive substring of the name, file name or URL."""
    q = query.strip().lower()
    return assets.filter(F.lower("name").contains(q) | F.lower("filename").contains(q) | F.lower("url").contains(q)) if q else assets


def sectionize(assets: DataFrame, tab: str = "all", query: str = "", sort: str = "relevance") -> DataFrame:
    """Assets with section, place of the section and rank in it; social pictures come first in images."""
    shown = searched(assets, query)
    if tab in ("svg", "images"):
        shown = shown.filter(F.col("kind") == ("svg" if tab == "svg" else "image"))
    shown = shown.withColumn("section", section_of(tab))
    place = F.lit(0)
    for i, name in enumerate(SECTIONS):
        place = F.when(F.col("section") == name, i).otherwise(place)
    order = Window.partitionBy("page_id", "section").orderBy(F.asc((F.col("section") == "images") & (F.col("role") != "social")), *sort_keys(sort))
    return shown.withColumn("place", place.cast("long")).withColumn("rank", F.row_number().over(order).cast("long"))


def visible_items(sections: DataFrame, collapsed: tuple[str, ...] = ("small-icons", "stylesheets")) -> DataFrame:
    """Items of open sections with their place on the page."""
    return sections.filter(~F.col("section").isin(*collapsed)).withColumn("item", F.row_number().over(Window.partitionBy("page_id").orderBy("place", "rank")).cast("long"))
