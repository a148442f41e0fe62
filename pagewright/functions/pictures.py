"""Picture rules as Column expressions: declared and SVG sizes, data URIs, magic bytes, SVG colours and canonical markup, fingerprints."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType

from .parsers import percent_decode

# Fixed values.
DRAWABLE = r"(?i)<(?:path|circle|rect|ellipse|line|polyline|polygon|text|image|use)\b"
HASH_BITS, MOST_DISTANCE, MOST_DRIFT, MOST_RMSE = 256, 20, 0.15, 3.0
_IDS = re.compile(r"""\bid\s*=\s*(["'])(?P<own>[^"']*)\1|\burl\(\s*#(?P<url>[^)\s"']+)\s*\)|\b(?:xlink:)?href\s*=\s*(["'])#(?P<href>[^"']*)\4""")


def _sizes(text: Column) -> Column:
    found = F.regexp_extract_all(F.substring(text, 1, 256), F.lit(r"(?<!\d)(\d{1,5}[xX]\d{1,5})(?!\d)"), 1)
    return F.transform(found, lambda s: F.split(s, "[xX]").cast("array<long>"))


def largest_icon_size(sizes: Column) -> Column:
    """width and height of the largest ``WxH`` in the first 256 characters, the first one on a tie; null without one."""
    areas = F.transform(_sizes(sizes), lambda s, i: F.struct((s[0] * s[1]).alias("area"), (-i).alias("at"), s[0].alias("width"), s[1].alias("height")))
    best = F.array_max(areas)
    return F.when(best.isNotNull(), F.struct(best["width"].alias("width"), best["height"].alias("height")))


def svg_size(markup: Column) -> Column:
    """width and height of the root's attributes, else of its viewBox; null where neither is whole."""
    root = F.substring(F.regexp_extract(markup, r"(?is)<svg\b[^>]*>", 0), 1, 4096)
    side = lambda name: F.regexp_extract(root, rf"""(?i)\s{name}\s*=\s*["']\s*(\d{{1,10}}(?:\.\d{{1,10}})?|\.\d{{1,10}})(?:px)?\s*["']""", 1).try_cast("double")
    box = F.transform(F.split(F.trim(F.regexp_extract(root, r"""(?i)\sviewBox\s*=\s*["']([^"']+)["']""", 1)), r"[\s,]+"), lambda x: x.try_cast("double"))
    whole = lambda w, h: F.when((w > 0) & (h > 0), F.struct(w.alias("width"), h.alias("height")))
    return F.coalesce(whole(side("width"), side("height")), F.when(F.size(box) == 4, whole(F.get(box, F.lit(2)), F.get(box, F.lit(3)))))


@F.pandas_udf(BinaryType())
def _percent_bytes(text: pd.Series) -> pd.Series:
    return text.map(lambda x: None if x is None else percent_decode(x))


def data_uri(uri: Column) -> Column:
    """mime and bytes of a data URI, null for anything else; a lone % stands for itself."""
    pattern = r"(?is)^data:([^;,]*)((?:;[^;,]*)*),(.*)$"
    mime, flags, body = (F.regexp_extract(uri, pattern, i) for i in (1, 2, 3))
    packed = flags.rlike("(?i);base64")
    raw = _percent_bytes(F.when(uri.rlike(pattern), body))
    padded = F.regexp_replace(F.regexp_replace(raw.cast("string"), r"[\s=]+", ""), "-", "+")
    padded = F.rpad(padded, (F.ceil(F.length(padded) / 4) * 4).cast("int"), F.lit("="))
    mime = F.lower(F.trim(F.when(mime == "", F.lit("text/plain")).otherwise(mime)))
    return F.when(uri.rlike(pattern), F.struct(mime.alias("mime"), F.when(packed, F.try_to_binary(padded, F.lit("base64"))).otherwise(raw).alias("bytes")))


def sniffed_type(data: Column) -> Column:
    """Media type by magic bytes, or by an SVG root behind XML declarations, comments and a document type; null for anything else."""
    head = F.hex(F.substring(data, 1, 64))
    text = F.substring(data, 1, 4096).cast("string")
    brand = head.rlike("^.{8}66747970(?:6176696[36]|61766973|.{8}.{8}(?:.{8})*?6176697[3]|.{8}.{8}(?:.{8})*?61766966)")
    svg = text.rlike(r"(?is)^﻿?\s*(?:<\?xml\b.*?\?>\s*)?(?:<!--.*?-->\s*|<\?(?!xml\b).*?\?>\s*|<!DOCTYPE\s+svg\b(?:[^>\[]*|[^>]*?\[.*?\]\s*)>\s*)*<svg[\s>/]")
    return (
        F.when(head.startswith("89504E470D0A1A0A"), "image/png").when(head.startswith("FFD8FF"), "image/jpeg").when(head.rlike("^47494638(?:37|39)61"), "image/gif")
        .when(head.rlike("^52494646.{8}57454250"), "image/webp").when(brand, "image/avif").when(head.startswith("00000100"), "image/x-icon").when(head.startswith("774F4646"), "font/woff")
        .when(head.startswith("774F4632"), "font/woff2").when(head.rlike("^(?:00010000|74727565)"), "font/ttf").when(head.startswith("4F54544F"), "font/otf").when(svg, "image/svg+xml")
    )


def sniffed_format(data: Column) -> Column:
    """Asset format of bytes; an icon file that declares no image is no icon."""
    kind, head = sniffed_type(data), F.hex(F.substring(data, 1, 6))
    names = {"image/png": "png", "image/jpeg": "jpg", "image/gif": "gif", "image/webp": "webp", "image/avif": "avif", "image/x-icon": "ico", "image/svg+xml": "svg"}
    out = F.when((F.octet_length(data) >= 10) & head.startswith("424D"), "bmp").when(head.rlike("^00000100(?:0000|.{0,3})$"), "other")
    for mime, name in names.items():
        out = out.when(kind == mime, name)
    return out.otherwise("other")


def extension(fmt: Column) -> Column:
    return F.when(fmt == "other", "bin").otherwise(fmt)


def is_sprite_sheet(markup: Column) -> Column:
    """Symbols, and nothing drawn outside of closed symbol and defs blocks."""
    rest = F.regexp_replace(F.regexp_replace(markup, r"(?is)<symbol\b.*?</symbol\s*>", ""), r"(?is)<defs\b.*?</defs\s*>", "")
    return markup.rlike(r"(?i)<symbol\b") & ~rest.rlike(DRAWABLE)


def svg_noise(markup: Column, visible: Column, width: Column, height: Column, most_bytes: int = 1024 * 1024) -> Column:
    """Why an inline SVG is noise, or null: over the cap, or seen and under 6 px."""
    return F.when(F.octet_length(markup) > most_bytes, "svg-too-large").when(visible & (F.greatest(width, height) < 6), "tiny-svg")


def normal_hex(value: Column) -> Column:
    """'#rrggbb' of 3, 4, 6 or 8 hex digits with or without #, alpha dropped; null for anything else."""
    digits = F.lower(F.regexp_extract(F.trim(value), "(?i)^#?([0-9a-f]{3,4}|[0-9a-f]{6}|[0-9a-f]{8})$", 1))
    short = F.regexp_replace(F.substring(digits, 1, 3), "(.)", "$1$1")
    return F.when(F.length(digits).isin(3, 4), F.concat(F.lit("#"), short)).when(F.length(digits) >= 6, F.concat(F.lit("#"), F.substring(digits, 1, 6)))


def svg_colors(markup: Column) -> Column:
    """hex and weight (of 1000, by number) of the colours that an SVG declares, in order; black for shapes without any."""
    pattern = r"""(?i)(?:fill|stroke|stop-color)\s{0,16}[:=]\s{0,16}["']?\s{0,16}(#[0-9a-f]{3,8}\b|rgba?\([^)]{0,64}\)|white|black)"""

    def one(raw: Column) -> Column:
        numbers = F.regexp_extract_all(raw, F.lit(r"([0-9.]+)"), 1)
        channel = lambda i: F.lpad(F.lower(F.hex(F.least(F.floor(F.get(numbers, F.lit(i)).try_cast("double") + 0.5), F.lit(255)).cast("long"))), 2, "0")
        return F.when(raw.rlike("(?i)^white"), "#ffffff").when(raw.rlike("(?i)^black"), "#000000").when(raw.startswith("#"), normal_hex(raw)).when(F.size(numbers) >= 3, F.concat(F.lit("#"), channel(0), channel(1), channel(2)))

    found = F.array_compact(F.transform(F.regexp_extract_all(markup, F.lit(pattern), 1), one))
    found = F.when((F.size(found) == 0) & markup.rlike(r"(?i)<(?:path|circle|rect|polygon)\b"), F.array(F.lit("#000000"))).otherwise(found)
    return F.transform(F.array_distinct(found), lambda h: F.struct(h.alias("hex"), (F.size(F.filter(found, lambda x: x == h)) * 1000.0 / F.size(found)).alias("weight")))


def canonical(markup: str | None) -> str | None:
    """SVG markup with its ids renumbered as they appear and, where it has a viewBox, without its root's size: what two copies of one drawing share."""
    if markup is None:
        return None
    root = re.search(r"<svg\b[^>]*>", markup, re.I)
    if root and re.search(r"\sviewBox\s*=", root[0], re.I):
        bare = re.sub(r"""\s(?:width|height)\s*=\s*(?:"[^"]*"|'[^']*'|[^\s>]+)""", "", root[0], flags=re.I)
        markup = markup[: root.start()] + bare + markup[root.end() :]
    numbers: dict[str, int] = {}

    def renumbered(m: re.Match) -> str:
        kind = m.lastgroup
        name = f"i{numbers.setdefault(m[kind], len(numbers))}"
        return {"own": f'id="{name}"', "url": f"url(#{name})", "href": f'href="#{name}"'}[kind]

    return _IDS.sub(renumbered, markup)


@F.pandas_udf(StringType())
def canonical_svg(markup: pd.Series) -> pd.Series:
    return markup.map(canonical)


def hamming(a: Column, b: Column) -> Column:
    """Bits by which two hex hashes differ; all of them where they can't be compared."""
    words = lambda h: F.transform(F.sequence(F.lit(0), F.lit(HASH_BITS // 32 - 1)), lambda i: F.conv(F.substring(h, i * 8 + 1, F.lit(8)), 16, 10).cast("long"))
    good = lambda h: h.rlike(f"^[0-9a-fA-F]{{{HASH_BITS // 4}}}$")
    bits = F.aggregate(F.zip_with(words(a), words(b), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    return F.when(good(a) & good(b), bits).otherwise(HASH_BITS)


def rmse(a: Column, b: Column) -> Column:
    """Root mean square difference of two thumbnails (arrays of grey values); 255 where they can't be compared."""
    total = F.aggregate(F.zip_with(a, b, lambda x, y: ((x - y) * (x - y)).cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.when((F.size(a) > 0) & (F.size(a) == F.size(b)), F.sqrt(total / F.size(a))).otherwise(255.0)


def same_visual(hash_a: Column, hash_b: Column, aspect_a: Column, aspect_b: Column, thumb_a: Column, thumb_b: Column) -> Column:
    drift = F.abs(aspect_a - aspect_b) / F.greatest(aspect_a, aspect_b)
    return (hamming(hash_a, hash_b) <= MOST_DISTANCE) & F.coalesce(drift <= MOST_DRIFT, F.lit(False)) & (rmse(thumb_a, thumb_b) <= MOST_RMSE)


def tone(pixels: int | Column, alpha_sum: Column, luminance_sum: Column) -> Column:
    """opaque, light, dark or mixed, of sums over a picture's pixels: alpha (0 to 1), and alpha times luminance (0 to 1)."""
    mean = luminance_sum / alpha_sum
    return F.when((pixels == 0) | (alpha_sum == 0), "unknown").when(alpha_sum / pixels >= 0.98, "opaque").when(mean > 0.7, "light").when(mean < 0.3, "dark").otherwise("mixed")
