"""Choosing assets for download: one plan from availability to byte budget, with a drop reason for each row that goes."""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules
from . import folds

# Fixed values.
FORMAT_ORDER = ("svg", "png", "webp", "avif", "jpg", "gif")
NO_SIZE_GATE = ("site-logo", "logo", "favicon")
MOST_FILES, MOST_BYTES, MOST_FILE_BYTES, LONG_SIDE = 60, 25 * 1024 * 1024, 8 * 1024 * 1024, 600


@dataclass(frozen=True)
class Options:
    """Sizes in pixels and bytes.  ``deck`` is the profile for slides, ``all`` takes everything of a kind.

    ``most_bytes`` and ``most_file_bytes``: None is the profile's default, 0 lifts the limit, and a number named holds in
    either profile.  ``min_long_side``: None is 600 in a deck and no gate in ``all``.  ``ids`` win over every rule but the cap."""

    profile: str = "deck"
    ids: tuple[str, ...] | None = None
    kinds: tuple[str, ...] = ()
    roles: tuple[str, ...] = ()
    name_contains: str = ""
    include_icons: bool = False
    min_long_side: int | None = None
    most: int = MOST_FILES
    most_bytes: int | None = None
    most_file_bytes: int | None = None


def format_rank() -> Column:
    return F.coalesce(F.array_position(F.array(*map(F.lit, FORMAT_ORDER)), F.col("format")) - 1, F.lit(-1)).cast("long")


def _side(intrinsic: str, rendered: str) -> Column:
    return F.coalesce(F.col(intrinsic), F.col(rendered))


def _preference() -> list[Column]:
    rank = F.when(F.col("format").isin(*FORMAT_ORDER), format_rank()).otherwise(len(FORMAT_ORDER))
    area = F.coalesce(_side("width", "rendered_w"), F.lit(0.0)) * F.coalesce(_side("height", "rendered_h"), F.lit(0.0))
    return [F.asc(F.col("kind") != "svg"), F.desc(area), rank.asc(), F.desc("score"), F.asc("ord"), F.asc("id")]


def _drop(rows: DataFrame, reason: str, condition: Column) -> DataFrame:
    """Mark what is still in and meets the condition; windows see what is still in only."""
    return rows.withColumn("drop_reason", F.coalesce("drop_reason", F.when(F.coalesce(condition, F.lit(False)), reason)))


def available(assets: DataFrame) -> Column:
    """Whether bytes can be had: inline markup, a display or an original URL, of the columns there are."""
    there = [F.col(c).isNotNull() for c in ("inline", "display_url", "url") if c in assets.columns]
    return functools.reduce(lambda a, b: a | b, there)


def weight(assets: DataFrame) -> Column:
    """What an asset weighs: its inline markup, else its bytes; 0 where not known."""
    inline = [F.octet_length("inline").cast("long")] if "inline" in assets.columns else []
    return F.coalesce(*inline, F.col("bytes"), F.lit(0)).cast("long")


def select_assets(assets: DataFrame, o: Options = Options()) -> DataFrame:
    """Every asset with drop_reason (null: kept), decided in the order of the rules.

    A page is a partition of all windows, so one exchange serves the plan."""
    live = F.col("drop_reason").isNull()
    deck = o.profile == "deck"
    rows = assets.withColumn("drop_reason", F.when(~available(assets), "unavailable"))
    if o.ids is not None:
        named = assets.sparkSession.createDataFrame([(x,) for x in sorted(set(o.ids))], "id string").withColumn("named", F.lit(True))
        rows = _drop(rows.join(F.broadcast(named), "id", "left"), "filter", F.col("named").isNull()).drop("named")
        return capped(rows, o.most)
    wanted = F.lit(True)
    for values, column in ((o.kinds, "kind"), (o.roles, "role")):
        wanted = wanted & F.col(column).isin(*values) if values else wanted
    if o.name_contains:
        wanted = wanted & F.lower("name").contains(o.name_contains.lower())
    rows = _drop(rows, "filter", ~wanted)
    icons = o.include_icons or "icon" in o.roles
    if deck:
        if "sprite-symbol" not in o.roles:
            rows = _drop(rows, "sprite", F.col("role") == "sprite-symbol")
        if not icons:
            rows = _drop(rows, "icon", F.col("role") == "icon")
        best = F.row_number().over(Window.partitionBy("page_id", F.col("role") == "favicon", live).orderBy(*_preference()))
        rows = _drop(rows.withColumn("n", best), "extra-favicon", (F.col("role") == "favicon") & (F.col("n") > 1))
    gate = o.min_long_side if o.min_long_side is not None else LONG_SIDE if deck else None
    if gate is not None:
        exempt = (F.col("kind") == "svg") | F.col("role").isin(*NO_SIZE_GATE) | (F.lit(icons) & (F.col("role") == "icon"))
        side = F.greatest(_side("width", "rendered_w"), _side("height", "rendered_h"))  # null only where neither side is known
        rows = _drop(rows, "small", ~exempt & (side < gate))
    ceiling = o.most_file_bytes if o.most_file_bytes is not None else MOST_FILE_BYTES if deck else 0
    if ceiling:
        rows = _drop(rows, "too-large", weight(assets) > ceiling)
    if deck:
        rows = rows.withColumn("slug", rules.normalized_name(F.coalesce(F.nullif("filename", F.lit("")), "name")))
        vector = F.max(live & (F.col("kind") == "svg")).over(Window.partitionBy("page_id", "slug"))
        rows = _drop(rows.withColumn("vector", vector), "vector-preferred", (F.col("kind") != "svg") & (F.col("slug") != "") & F.col("vector"))
    same = F.row_number().over(Window.partitionBy("page_id", "sha1", live).orderBy(*_preference()))
    rows = _drop(rows.withColumn("n", same), "duplicate", F.col("sha1").isNotNull() & (F.col("n") > 1))
    rows = capped(rows, o.most).drop("n", "slug", "vector")
    budget = MOST_BYTES if o.most_bytes is None else o.most_bytes
    return over_budget(rows, budget) if budget else rows


def duplicate_groups(selection: DataFrame) -> DataFrame:
    """page_id, kept_id, and dropped_ids in relevance order, of each exact duplicate whose winner stayed.  One row for each loser is collected by its hash."""
    kept = selection.filter("drop_reason is null and sha1 is not null").select("page_id", "sha1", F.col("id").alias("kept_id"))
    lost = selection.filter("drop_reason = 'duplicate'").groupBy("page_id", "sha1").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "ord", "id"))).alias("x"))
    return kept.join(lost, ["page_id", "sha1"]).select("page_id", "kept_id", F.transform("x", lambda e: e["id"]).alias("dropped_ids"))


def capped(rows: DataFrame, most: int) -> DataFrame:
    """Each kind keeps its share of the cap in relevance order; what is left goes to the most relevant of the rest."""
    live = F.col("drop_reason").isNull()
    order = [F.desc("score"), F.asc("ord"), F.asc("id")]
    pool = F.sum(live.cast("long")).over(Window.partitionBy("page_id"))
    of_kind = F.sum(live.cast("long")).over(Window.partitionBy("page_id", "kind"))
    rows = rows.withColumn("pool", pool).withColumn("quota", F.floor(most * of_kind / F.greatest("pool", F.lit(1))))
    in_kind = F.row_number().over(Window.partitionBy("page_id", "kind", live).orderBy(*order))
    rows = rows.withColumn("first", live & ((F.col("pool") <= most) | (in_kind <= F.col("quota"))))
    taken = F.sum(F.col("first").cast("long")).over(Window.partitionBy("page_id"))
    rest = F.row_number().over(Window.partitionBy("page_id", live & ~F.col("first")).orderBy(*order))
    rows = _drop(rows.withColumn("left", most - taken).withColumn("rest", rest), "cap", ~F.col("first") & (F.col("rest") > F.col("left")))
    return rows.drop("pool", "quota", "first", "left", "rest")


def over_budget(rows: DataFrame, most_bytes: int) -> DataFrame:
    """Greedy in relevance order: what does not fit is left out and the next is tried."""
    kept = rows.filter("drop_reason is null").select("page_id", "id", "score", "ord", weight(rows).alias("b"))
    out = folds.folded(kept, "page_id", [F.desc("score"), F.asc("ord"), F.asc("id")], "b", 0, folds.greedy(most_bytes), "fits").filter("fits = 0").select("page_id", "id", F.lit(True).alias("over"))
    return _drop(rows.join(out, ["page_id", "id"], "left"), "over-budget", F.col("over")).drop("over")


def dropped(selection: DataFrame) -> DataFrame:
    """page_id, drop_reason ('kept' for what stays), n and bytes."""
    return selection.groupBy("page_id", F.coalesce("drop_reason", F.lit("kept")).alias("drop_reason")).agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"))
