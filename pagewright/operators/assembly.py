"""From a page's candidates and captures to its named assets: one plan over all pages.

Records by URL, what the network captured of them, noise, size variants, facts of each group, role, relevance, caps, names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names, originals, pictures, rules
from . import assets, folds

MOST_ASSETS, MOST_INLINE, MOST_INLINE_ALL = 1500, 2 * 1024 * 1024, 16 * 1024 * 1024


def facts(rows: DataFrame, keys: list[str]) -> DataFrame:
    """What the candidates of a URL, or of a group of variants, say together: places in the order they come in, least order, any and all flags,
    largest sizes, first label, link text, logo evidence and number of elements.

    Counted by place first, of which there are few kinds, so what is collected for a key is bounded."""
    area = lambda w, h: F.coalesce(F.col(w) * F.col(h), F.lit(0.0))
    first = lambda c: F.min(F.when(F.col(c).isNotNull(), F.struct("ord", c)))
    one = {
        "ord": F.min("ord"), "visible": F.max("visible"), "declared_only": F.min("declared_only"), "logo_score": F.max("logo_score"), "logo_word": F.max("logo_word"),
        "natural": F.max(F.struct(area("natural_w", "natural_h").alias("area"), (-F.col("ord")).alias("at"), "natural_w", "natural_h")),
        "rendered": F.max(F.when(F.col("visible"), F.struct(area("rendered_w", "rendered_h").alias("area"), (-F.col("ord")).alias("at"), "rendered_w", "rendered_h"))),
        "label": first("label"), "link_text": first("link_text"), "grp": first("grp"),
    }
    least = {"ord", "declared_only", "label", "link_text", "grp"}
    by_place = rows.groupBy(*keys, "found_in").agg(*[f.alias(c) for c, f in one.items()])
    both = by_place.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("ord", "found_in"))).alias("places"), *[(F.min if c in least else F.max)(c).alias(c) for c in one])
    uses = rows.filter("grp is not null").select(*keys, "grp").distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("uses"))
    out = both.join(uses, keys, "left")
    return out.select(*keys, F.transform("places", lambda p: p["found_in"]).alias("found_in"), "ord", "visible", "declared_only", "logo_score", "logo_word", "natural.natural_w", "natural.natural_h", "rendered.rendered_w", "rendered.rendered_h", F.col("label.label").alias("label"), F.col("link_text.link_text").alias("link_text"), F.col("grp.grp").alias("grp"), F.greatest(F.coalesce("uses", F.lit(1)), F.lit(1)).alias("used_count"))


def records(candidates: DataFrame, captures: DataFrame) -> DataFrame:
    """One row for each URL of a page with its capture, and the captured images that no candidate names; with noise reason, variant key and base name."""
    known = facts(candidates, ["page_id", "url"])
    good = captures.filter((F.col("status") >= 200) & (F.col("status") < 400))
    highest = known.groupBy("page_id").agg(F.max("ord").alias("last"))
    alone = good.join(known, ["page_id", "url"], "left_anti").join(highest, "page_id", "left")
    # A response without a candidate comes after the last element.
    alone = alone.select("page_id", "url", F.array(F.lit("network")).alias("found_in"), (F.coalesce("last", F.lit(0)) + 1).alias("ord"), F.lit(False).alias("visible"), F.lit(False).alias("declared_only"))
    rows = known.unionByName(alone, allowMissingColumns=True).join(captures, ["page_id", "url"], "left")
    none = F.lit(None)
    failed = F.col("status").isNotNull() & ~F.col("status").between(200, 399)
    reason = F.when(failed, "not-image").otherwise(rules.noise_reason(F.col("url"), F.col("content_type"), F.col("width"), F.col("height"), F.col("bytes").cast("double"), none.cast("string"), none.cast("boolean")))
    return originals.with_originals(rows.withColumn("reason", reason))


def _kept_inline(drafts: DataFrame) -> DataFrame:
    """Inline pictures within their caps, most relevant first, and then the most relevant assets of a page."""
    order = [F.desc("score"), F.asc("ord"), F.asc("id")]
    sized = drafts.withColumn("inline_size", F.when(F.col("inline_bytes") > MOST_INLINE, F.lit(MOST_INLINE_ALL + 1)).otherwise(F.coalesce("inline_bytes", F.lit(0))).cast("long"))
    within = folds.folded(sized, "page_id", order, "inline_size", 0, folds.greedy(MOST_INLINE_ALL), "fits").filter("fits = 1").drop("fits", "inline_size")
    return within.withColumn("rank", F.row_number().over(Window.partitionBy("page_id").orderBy(*order))).filter(F.col("rank") <= MOST_ASSETS)


def assemble(candidates: DataFrame, captures: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Named assets of every page, and page_id, reason and n of what was hidden.

    ``candidates``: page_id, url, ord, found_in, grp, visible, declared_only, natural and rendered sizes, label, link_text, logo_score, logo_word.
    ``captures``: page_id, url, status, content_type, width, height, bytes.  ``pages``: page_id, site.  A file that was not captured is taken to be
    what its URL says."""
    rows = records(candidates, captures)
    hidden = rows.filter("reason is not null").groupBy("page_id", "reason").agg(F.count(F.lit(1)).alias("n"))
    fmt = rules.format_of(F.col("content_type"), F.col("url"))
    kept = rows.filter("reason is null").withColumn("format", fmt).withColumn("kind", F.when(F.col("format") == "svg", "svg").otherwise("image"))
    kept = kept.withColumn("idx", F.xxhash64("url")).withColumn("size_score", rules.size_score(F.col("width") * F.col("height"), F.col("natural_w") * F.col("natural_h"), F.lit(None).cast("double"), F.lit(None).cast("double"), F.lit(None).cast("double"), F.col("bytes")))
    members = kept.select("page_id", "idx", "kind", F.array_compact(F.array("grp")).alias("groups"), F.col("grp").alias("preferred_group"), F.lit(False).alias("art_directed"), "variant_key", F.lit(None).cast("string").alias("sha1"))
    kept = kept.join(assets.variant_groups(members), ["page_id", "idx"])
    # A captured member is what can be had; of those the largest is the best, the first on a tie.
    order = F.struct(F.col("status").isNotNull().cast("int"), "size_score", -F.col("ord"), "url")
    best = kept.groupBy("page_id", "root", "group_kind").agg(F.max_by(F.struct("url", "format", "variant_key", "base_name", "width", "height", "natural_w", "natural_h", "bytes"), order).alias("best"), F.count(F.lit(1)).alias("members"))
    seen = candidates.join(kept.select("page_id", "url", "root", "group_kind"), ["page_id", "url"])
    only = kept.filter(F.array_contains("found_in", "network")).select("page_id", "root", "group_kind", F.lit("network").alias("found_in"), "ord", F.lit(False).alias("visible"), F.lit(False).alias("declared_only"))
    said = facts(seen.unionByName(only, allowMissingColumns=True), ["page_id", "root", "group_kind"])
    out = best.join(said.drop("natural_w", "natural_h"), ["page_id", "root", "group_kind"]).select("*", "best.*").drop("best")
    w, h = (F.coalesce(F.col(a), F.col(b), F.lit(0.0)) for a, b in (("width", "natural_w"), ("height", "natural_h")))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    no = F.lit(False)
    role = rules.role(F.col("group_kind"), F.col("format"), F.col("found_in"), F.coalesce("logo_score", F.lit(0)), F.coalesce("logo_word", no), no, F.col("label"), no, w, h, zero("rendered_w"), zero("rendered_h"), no, no)
    out = out.withColumn("role", role).withColumn("score", rules.relevance(F.col("role"), zero("rendered_w"), zero("rendered_h"), F.col("visible"), F.col("ord")))
    out = out.withColumn("id", F.sha1(F.coalesce("variant_key", "url"))).withColumn("kind", F.col("group_kind")).withColumn("inline_bytes", F.when(F.col("url").startswith("data:"), F.col("bytes")))
    out = _kept_inline(out).withColumn("kind_index", F.row_number().over(Window.partitionBy("page_id", "kind").orderBy("ord", "id")).cast("long"))
    out = names.named(out.join(pages.select("page_id", "site"), "page_id", "left")).withColumn("extension", pictures.extension(F.col("format")))
    return names.with_file_names(out, [F.asc("rank")]), hidden


def captured_once(captures: DataFrame) -> DataFrame:
    """One capture for each URL of a page: a good response replaces a failed one, then the first stays."""
    good = F.col("status").between(200, 399).cast("int")
    return captures.groupBy("page_id", "url").agg(F.max_by(F.struct(*[c for c in captures.columns if c not in ("page_id", "url")]), F.struct(good, -F.col("seq"))).alias("x")).select("page_id", "url", "x.*")


def probe_counters(probes: DataFrame) -> DataFrame:
    """Of the originals that were tried, by page: attempted (a request went out), adopted, captured, failed, noise, skipped."""
    outcome = lambda x: F.count_if(F.col("outcome") == x).alias(x)
    return probes.groupBy("page_id").agg(F.count_if(F.col("outcome") != "captured").alias("attempted"), *[outcome(x) for x in ("adopted", "captured", "failed", "noise", "skipped")])


def listed(assets_: DataFrame, kind: str | None = None, role: str | None = None, min_long_side: float | None = None, name_contains: str | None = None) -> DataFrame:
    """The rows of a plain listing: here the size gate spares vectors and what was never measured, and no role."""
    side: Column = F.greatest(F.coalesce("width", "rendered_w"), F.coalesce("height", "rendered_h"))
    out = assets_
    for value, test in ((kind, lambda: F.col("kind") == kind), (role, lambda: F.col("role") == role), (name_contains, lambda: F.lower("name").contains(name_contains.lower())), (min_long_side, lambda: (F.col("kind") == "svg") | side.isNull() | (side >= min_long_side))):
        out = out.filter(test()) if value is not None else out
    return out


def requested(assets_: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The assets of the ids that a caller names, and the ids that no asset has."""
    wanted = ids.select("id").distinct()
    return assets_.join(wanted, "id", "left_semi"), wanted.join(assets_, "id", "left_anti")


def merged_svgs(svgs: DataFrame) -> DataFrame:
    """One row for each distinct drawing of a page: uses add up, any visible, the largest rectangle, the first label, the least order."""
    area = F.coalesce(F.col("width") * F.col("height"), F.lit(0.0))
    out = svgs.withColumn("canonical", pictures.canonical_svg("markup")).withColumn("hash", F.sha1("canonical"))
    out = out.groupBy("page_id", "hash").agg(F.min("ord").alias("ord"), F.sum("used_count").alias("used_count"), F.max("visible").alias("visible"), F.max(F.struct(area, -F.col("ord"), "width", "height")).alias("box"), F.min(F.when(F.col("label").isNotNull(), F.struct("ord", "label"))).alias("named"))
    return out.select("page_id", "hash", "ord", "used_count", "visible", "box.width", "box.height", F.col("named.label").alias("label"))


def sprite_uses(symbols: DataFrame, uses: DataFrame) -> DataFrame:
    """Each sprite symbol with how often the page uses it; reason is set for those it never does."""
    counted = uses.groupBy("page_id", "symbol").agg(F.count(F.lit(1)).alias("n"))
    return symbols.join(counted, ["page_id", "symbol"], "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("reason", F.when(F.col("n") == 0, "unreferenced-symbol"))
