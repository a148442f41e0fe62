"""Picture candidates in the markup of pages: element sources, metadata, styles, web manifests."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urldefrag, urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import reachable
from .parsers import css_urls, parse_srcset

# Fixed values.
ICON_RELS = frozenset("icon shortcut apple-touch-icon apple-touch-icon-precomposed mask-icon fluid-icon".split())
META_PLACES = ((r"og:image(?::url|:secure_url)?|image|thumbnail", "og-image"), (r"twitter:image(?::src)?", "twitter-image"), (r"msapplication-(?:tileimage|square70x70logo|square150x150logo|wide310x150logo|square310x310logo)", "meta-icon"))
LAZY = re.compile(r"^data-(?:lazy-?)?(?:src|srcset|original|lazy)(?:-?set)?$", re.I)
LAZY_BACKGROUND = re.compile(r"^data-(?:bg|background|background-image|lazy-background)$", re.I)
NOT_PICTURES = re.compile(r"^(?:src|font|font-family|content-visibility|behavior|-ms-behavior)$")
PICTURE_FILE = re.compile(r"\.(?:svg|png|jpe?g|gif|webp)(?:[?#]|$)", re.I)
SKIPPED = frozenset("script style link meta source picture".split())
MOST_DEPTH = 6


class Collector(HTMLParser):
    """Candidates (ord, found_in, url, w, x, grp, media) of one page, in the order of its elements; ``grp`` numbers elements."""

    def __init__(self, base: str):
        super().__init__(convert_charrefs=True)
        self.base, self.rows, self.element, self.held, self.sources, self.data = base, [], 0, None, [], []
        self.manifest: str | None = None
        self.picture = 0

    def add(self, url: str | None, found_in: str, w: float | None = None, x: float | None = None, media: str | None = None) -> None:
        text = (url or "").strip()
        if not text:
            return
        try:
            whole = urldefrag(urljoin(self.base, text))[0]
        except ValueError:
            return
        if re.match(r"(?:https?|data|blob):", whole, re.I):
            self.rows.append((len(self.rows), found_in, whole, w, x, self.element, media))

    def add_set(self, value: str | None, found_in: str, media: str | None = None) -> None:
        for c in parse_srcset(value):
            self.add(c["url"], found_in, c["w"], c["x"], media)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if self.held == tag:
            self.handle_endtag(tag)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.element += 1
        a: dict[str, str] = {}
        for name, value in attrs:  # the first of two holds
            a.setdefault(name, value or "")
        get = a.get
        if tag == "picture":
            self.picture, self.sources = self.element, []
        elif tag == "source" and self.picture:
            self.sources += [(get(n), get("media")) for n in ("srcset", "data-srcset") if get(n)]
        elif tag == "img" or (tag == "input" and (get("type") or "").lower() == "image"):
            self._image(tag, a)
        elif tag == "video":
            self.add(get("poster") or get("data-poster"), "video-poster")
        elif tag == "image":
            self.add(get("href") or get("xlink:href"), "svg-image")
        elif tag in ("object", "embed", "iframe"):
            value = get("data" if tag == "object" else "src") or ""
            shown = re.search(r"\.svg(?:[?#]|$)", value, re.I) if tag == "iframe" else re.search("svg|image", get("type") or "", re.I) or PICTURE_FILE.search(value)
            if shown:
                self.add(value, "object-embed")
        elif tag == "link":
            self._link(a)
        elif tag == "meta" and get("content"):
            key = (get("property") or get("name") or get("itemprop") or "").lower()
            for pattern, place in META_PLACES:
                if re.fullmatch(pattern, key):
                    self.add(get("content"), place)
        elif tag == "base" and get("href"):
            self.base = urljoin(self.base, get("href"))
        if tag in ("style", "noscript") or (tag == "script" and (get("type") or "").strip().lower() == "application/ld+json"):
            self.held, self.data = tag, []
        if tag not in SKIPPED:
            for name, value in a.items():
                if name == "style":
                    for url in css_urls(value):
                        self.add(url, "css-background")
                elif LAZY_BACKGROUND.match(name) and value and value.lstrip()[:1] not in "{[":
                    self.add((css_urls(value) or [value])[0], "lazy-attribute")

    def _image(self, tag: str, a: dict[str, str]) -> None:
        self.add(a.get("src"), "img")
        self.add_set(a.get("srcset"), "img")
        for name, value in a.items():
            if LAZY.match(name) and value and value.lstrip()[:1] not in "{[":
                if "set" in name or re.search(r"\s\d+[wx]\s*(?:,|$)", value):
                    self.add_set(value, "lazy-attribute")
                else:
                    self.add(value, "lazy-attribute")
        if tag == "img" and self.picture:
            for value, media in self.sources:
                self.add_set(value, "picture", media)

    def _link(self, a: dict[str, str]) -> None:
        rel, href = (a.get("rel") or "").lower().split(), a.get("href")
        if href and ICON_RELS & set(rel):
            self.add(href, "icon-link")
        elif href and ("image_src" in rel or "image" in (a.get("itemprop") or "").lower().split()):
            self.add(href, "og-image")
        elif href and "manifest" in rel and not self.manifest:
            self.manifest = urljoin(self.base, href)

    def handle_data(self, data: str) -> None:
        if self.held:
            self.data.append(data)

    def handle_endtag(self, tag: str) -> None:
        if tag == "picture":
            self.picture, self.sources = 0, []
        if tag != self.held:
            return
        text, self.held = "".join(self.data), None
        if tag == "style":
            for found in stylesheet_urls(text):
                self.add(found["url"], "stylesheet")
        elif tag == "script":
            for url in json_logos(text):
                self.add(url, "json-ld")


def json_logos(text: str) -> list[str]:
    """The logos that a JSON-LD document names, at most six levels deep."""
    try:
        left = [(json.loads(re.sub(r"^\s*<!--|-->\s*$", "", text)), 0)]
    except (ValueError, RecursionError):
        return []
    out: list[str] = []
    while left:
        value, depth = left.pop(0)
        if depth > MOST_DEPTH:
            continue
        if isinstance(value, list):
            left = [(v, depth + 1) for v in value] + left
        elif isinstance(value, dict):
            inner = []
            for key, v in value.items():
                logo = (v if isinstance(v, str) else v.get("url", v.get("contentUrl")) if isinstance(v, dict) else None) if key == "logo" else None
                if isinstance(logo, str):
                    out.append(logo)
                elif key != "logo":
                    inner.append((v, depth + 1))
            left = inner + left
    return out


def stylesheet_urls(text: str) -> list[dict]:
    """url, property, declaration (its number) and image_set of each URL in the declarations of a stylesheet, those of @font-face and of properties that show no picture aside.

    One pass over the text: strings, comments and brackets are stepped over, blocks may nest."""
    out: list[dict] = []
    parts = re.compile(r"""/\*.*?(?:\*/|\Z)|"(?:[^"\\\n]|\\.)*"?|'(?:[^'\\\n]|\\.)*'?|url\(\s*[^"'()\s][^)]*\)?|[{}();]""", re.S | re.I)
    start, depth, count, faces = 0, 0, 0, []

    def read(end: int) -> None:
        nonlocal count
        piece = re.sub(r"/\*.*?(?:\*/|\Z)", " ", text[start:end], flags=re.S)
        name, colon, value = piece.partition(":")
        name = name.strip()
        if not colon or not re.fullmatch(r"-{0,2}[A-Za-z_][\w-]*", name) or not re.search(r"url\(|image-set\(", value, re.I):
            return
        name = name if name.startswith("--") else name.lower()
        if NOT_PICTURES.match(name):
            return
        out.extend({"url": url, "property": name, "declaration": count, "image_set": bool(re.search(r"image-set\(", value, re.I))} for url in css_urls(value))
        count += 1

    for m in parts.finditer(text):
        mark = m[0]
        if mark == "(":
            depth += 1
        elif mark == ")":
            depth = max(0, depth - 1)
        elif depth or mark not in "{};":
            continue
        elif mark == "{":
            faces.append(text[start : m.start()].strip().lower() == "@font-face" or (bool(faces) and faces[-1]))
            start = m.end()
        else:
            if faces and not faces[-1]:
                read(m.start())
            if mark == "}" and faces:
                faces.pop()
            start = m.end()
    if faces and not faces[-1]:
        read(len(text))
    return out


def candidates(pages: DataFrame) -> DataFrame:
    """page_id, ord, found_in, url, w, x, grp (element) and media of every picture that a page's markup names (page_id, url, html); and its manifest, as found_in manifest-link.

    Null or empty html has none."""
    reachable(pages.sparkSession)
    names = ["page_id", "ord", "found_in", "url", "w", "x", "grp", "media"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for page, url, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = Collector(url or "")
                found.feed(html or "")
                found.close()
                rows += [(page, *r) for r in found.rows]
                if found.manifest:
                    rows.append((page, len(found.rows), "manifest-link", found.manifest, None, None, None, None))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(run, "page_id long, ord long, found_in string, url string, w double, x double, grp long, media string")


def manifest_icons(manifests: DataFrame) -> DataFrame:
    """page_id, pos, src, sizes and type of the icons of web manifests (page_id, body); what is no such JSON has none."""
    icons = F.from_json("body", "icons array<struct<src: string, sizes: string, type: string>>")["icons"]
    return manifests.select("page_id", F.posexplode(icons).alias("pos", "i")).filter("i.src is not null").select("page_id", F.col("pos").cast("long").alias("pos"), "i.src", "i.sizes", "i.type")


def css_color(value: Column) -> Column:
    """r, g, b and a of rgb() and rgba() and of hex colours; null for others and for what is all but transparent."""
    v = F.lower(F.trim(value))
    numbers = F.transform(F.regexp_extract_all(v, F.lit(r"([0-9.]+%?)"), 1), lambda x: F.when(x.endswith("%"), F.replace(x, F.lit("%"), F.lit("")).try_cast("double") / 100).otherwise(x.try_cast("double")))
    alpha = F.when(F.size(numbers) > 3, F.get(numbers, F.lit(3))).otherwise(1.0)
    digits = F.regexp_extract(v, "^#([0-9a-f]{6})([0-9a-f]{2})?$", 1)
    pair = lambda i: F.conv(F.substring(digits, i, 2), 16, 10).cast("double")
    last = F.regexp_extract(v, "^#[0-9a-f]{6}([0-9a-f]{2})$", 1)
    from_hex = F.struct(pair(1).alias("r"), pair(3).alias("g"), pair(5).alias("b"), F.when(last != "", F.conv(last, 16, 10).cast("double") / 255).otherwise(1.0).alias("a"))
    from_rgb = F.struct(*[F.get(numbers, F.lit(i)).alias(n) for i, n in enumerate("rgb")], alpha.alias("a"))
    found = F.when(digits != "", from_hex).when(v.rlike(r"^rgba?\(") & (F.size(numbers) >= 3), from_rgb)
    return F.when(found["a"] >= 0.02, found)


def over(top: Column, ground: Column) -> Column:
    """The colour ('#rrggbb') of one (r, g, b, a) upon an opaque other."""
    mixed = lambda n: F.lpad(F.lower(F.hex(F.floor(top[n] * top["a"] + ground[n] * (1 - top["a"]) + 0.5).cast("long"))), 2, "0")
    return F.concat(F.lit("#"), *[mixed(n) for n in "rgb"])
