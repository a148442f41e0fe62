"""What people read: sizes, counts, durations, badges, hidden files; and names of folders and files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rules import format_bytes

# Fixed values.
HIDDEN = {
    "tracker": ("a tracking pixel", "tracking pixels"), "pixel": ("a tracking pixel", "tracking pixels"), "spacer": ("a spacer image", "spacer images"), "tiny-data-uri": ("a spacer image", "spacer images"),
    "placeholder": ("a placeholder", "placeholders"), "not-image": ("a broken file", "broken files"), "consent": ("a consent banner", "consent banners"), "widget": ("a third-party widget", "third-party widgets"),
    "probe-failed": ("an unreachable file", "unreachable files"), "probe-skipped": ("an unchecked file", "unchecked files"), "blob-unavailable": ("an unreadable image", "unreadable images"),
    "lottie-frame": ("an animation frame", "animation frames"), "tiny-svg": ("a tiny SVG", "tiny SVGs"), "svg-too-large": ("an oversized SVG", "oversized SVGs"), "unreferenced-symbol": ("an unused sprite symbol", "unused sprite symbols"),
}
BADGES = {"site-logo": "Logo", "logo": "Logo", "favicon": "Favicon", "social": "OG image"}
FOUND_IN = {
    "img": "<img> tag", "picture": "<picture> source", "lazy-attribute": "Lazy-load attribute", "noscript": "<noscript> fallback", "video-poster": "Video poster", "svg-image": "SVG <image>", "object-embed": "<object> or <embed>",
    "css-background": "CSS background", "css-mask": "CSS mask", "css-pseudo": "CSS pseudo-element", "css-other": "CSS property", "stylesheet": "Stylesheet", "icon-link": '<link rel="icon">', "meta-icon": "Meta tag",
    "manifest": "Web app manifest", "og-image": "og:image tag", "twitter-image": "twitter:image tag", "json-ld": "JSON-LD logo", "inline-svg": "Inline <svg>", "sprite-symbol": "Sprite symbol", "network": "Network request",
    "shadow-dom": "Shadow DOM", "iframe": "Same-origin iframe", "public-source": "Public source",
}


def _table(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def dimensions(width: Column, height: Column) -> Column:
    rounded = lambda x: F.floor(x + 0.5).cast("long").cast("string")
    return F.when((width > 0) & (height > 0), F.concat(rounded(width), F.lit("×"), rounded(height))).otherwise("")


def duration(ms: Column) -> Column:
    s = F.greatest(F.floor(ms / 1000 + 0.5), F.lit(0)).cast("long")
    return F.when(s < 60, F.concat(s.cast("string"), F.lit("s"))).otherwise(F.concat(F.floor(s / 60).cast("string"), F.lit("m "), (s % 60).cast("string"), F.lit("s")))


def count(n: Column, one: str, many: str) -> Column:
    return F.concat(F.format_number(n, 0), F.when(F.abs(n) == 1, f" {one}").otherwise(f" {many}"))


def badge(role: Column, section: Column) -> Column:
    return F.when(~(role.isin("site-logo", "logo") & (section == "logos")), F.element_at(_table(BADGES), role))


def meta_line(fmt: Column, kind: Column, width: Column, height: Column, n_bytes: Column, inline: Column) -> Column:
    """The parts of a card's line that are known."""
    size = F.nullif(dimensions(width, height), F.lit(""))
    return F.concat_ws(" · ", F.when(fmt == "other", "FILE").otherwise(F.upper(fmt)), size, F.when(n_bytes > 0, format_bytes(n_bytes.cast("double"))), F.when(kind == "svg", F.when(inline, "Inline").otherwise("File")))


def found_in_label(places: Column) -> Column:
    table = _table(FOUND_IN)
    return F.array_join(F.transform(places, lambda p: F.element_at(table, p)), ", ")


def hidden_summary(hidden: DataFrame) -> DataFrame:
    """page_id and summary of ``hidden`` (page_id, reason, n): the three commonest phrases, what is left as other files.

    Reasons with one phrase add up; of equal numbers, the one first in the table comes first."""
    at = {many: i for i, (_, many) in reversed(list(enumerate(HIDDEN.values())))}
    known = F.element_at(_table({k: v[1] for k, v in HIDDEN.items()}), F.col("reason"))
    by_phrase = hidden.filter("n > 0").groupBy("page_id", F.coalesce(known, F.lit("")).alias("many")).agg(F.sum("n").alias("n"))
    place = F.element_at(_table({m: str(i) for m, i in at.items()}), F.col("many")).cast("int")
    pages = by_phrase.groupBy("page_id").agg(F.sum("n").alias("total"), F.array_sort(F.collect_list(F.when(F.col("many") != "", F.struct((-F.col("n")).alias("n"), place.alias("at"), "many")))).alias("x"), F.sum(F.when(F.col("many") == "", F.col("n")).otherwise(0)).alias("unknown"))
    single = _table({v[1]: v[0] for v in HIDDEN.values()})
    shown = F.transform(F.slice("x", 1, 3), lambda e: F.when(e["n"] == -1, F.element_at(single, e["many"])).otherwise(e["many"]))
    others = F.aggregate(F.slice("x", 4, 100), F.col("unknown"), lambda s, e: s - e["n"])
    phrases = F.when(others > 0, F.array_append(shown, F.when(others == 1, "another file").otherwise("other files"))).otherwise(shown)
    listed = F.when(F.size("p") == 1, F.col("p")[0]).otherwise(F.concat(F.array_join(F.slice("p", F.lit(1), F.size("p") - 1), ", "), F.lit(" and "), F.element_at("p", -1)))
    return pages.withColumn("p", phrases).select("page_id", F.concat(F.format_number("total", 0), F.lit(" hidden: "), listed).alias("summary"))


def safe_host(host: Column) -> Column:
    """A host as a folder name."""
    out = F.regexp_replace(F.regexp_replace(F.lower(F.trim(host)), r"^www\.", ""), "[^a-z0-9.-]+", "-")
    out = F.regexp_replace(F.regexp_replace(out, r"\.{2,}", "."), "^[.-]+|[.-]+$", "")
    return F.coalesce(F.nullif(F.regexp_replace(F.substring(out, 1, 100), "[.-]+$", ""), F.lit("")), F.lit("site"))


def safe_file_name(value: Column, fallback: Column) -> Column:
    """The last path segment without what file systems read as special."""
    last = F.regexp_extract(value, r"([^\\/]*)$", 1)
    clean = F.substring(F.regexp_replace(F.regexp_replace(last, r'[\x00-\x1f\x7f:*?"<>|]+', "-"), r"^[\s.]+|[\s.]+$", ""), 1, 120)
    return F.coalesce(F.nullif(clean, F.lit("")), fallback)


def written_name(name: Column, asset_id: Column, fmt: Column) -> Column:
    """The name that an asset is written under: its own, with its format's extension."""
    end = F.when(fmt == "other", "bin").otherwise(fmt)
    safe = safe_file_name(name, F.concat(asset_id, F.lit("."), end))
    return F.concat(F.regexp_replace(safe, r"(?<=.)\.[^.]*$", ""), F.lit("."), end)
