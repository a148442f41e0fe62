"""Parsers that need a scanner: one Arrow batch at a time, over distinct inputs."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import reachable

_DESCRIPTOR = re.compile(r"^(\d+(?:\.\d+)?)([wx])$")


def parse_srcset(value: str | None) -> list[dict]:
    """url, w and x of each candidate; a URL runs to white space, commas in it are kept, commas that end it split."""
    out, at, text = [], 0, value or ""
    while at < len(text):
        while at < len(text) and (text[at].isspace() or text[at] == ","):
            at += 1
        start = at
        while at < len(text) and not text[at].isspace():
            at += 1
        url, w, x = text[start:at], None, None
        if not url:
            break
        bare = url.rstrip(",")
        if bare != url:
            out.append({"url": bare, "w": None, "x": 1.0})
            continue
        depth, begin = 0, at
        while at < len(text) and (text[at] != "," or depth):
            depth += (text[at] == "(") - (text[at] == ")" and depth > 0)
            at += 1
        for token in text[begin:at].split():
            m = _DESCRIPTOR.match(token)
            if m and m[2] == "w":
                w = float(m[1])
            elif m:
                x = float(m[1])
        out.append({"url": bare, "w": w, "x": x if x is not None else None if w is not None else 1.0})
    return out


_CSS = re.compile(r"""/\*.*?(?:\*/|\Z)|url\(\s*(?:"((?:[^"\\\n]|\\.)*)"|'((?:[^'\\\n]|\\.)*)'|((?:[^\s"'()\\]|\\.)*))\s*\)|image-set\(\s*(?:"([^"\n]*)"|'([^'\n]*)')|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'""", re.S | re.I)
_ESCAPE = re.compile(r"\\(?:([0-9a-fA-F]{1,6})\s?|(.))", re.S)


def _unescape(text: str) -> str:
    return _ESCAPE.sub(lambda m: chr(min(int(m[1], 16), 0x10FFFF) or 0xFFFD) if m[1] else m[2], text)


def css_urls(value: str | None) -> list[str]:
    """Distinct url() and first image-set() strings in order, without fragments; comments and other strings are skipped."""
    out: dict[str, None] = {}
    for m in _CSS.finditer(value or ""):
        raw = next((g for g in m.groups() if g is not None), None)
        url = _unescape(raw).split("#")[0].strip() if raw else ""
        if url:
            out.setdefault(url)
    return list(out)


_FACE = re.compile(r"@font-face\s*\{([^{}]*)\}", re.I)
_SOURCE = re.compile(r"""(?:url\(\s*(?:"([^"]*)"|'([^']*)'|([^)\s]*))\s*\)(?:\s*format\(\s*["']?([^"')]*)["']?\s*\))?)|local\(\s*["']?([^"')]*)["']?\s*\)""", re.I)


def font_faces(value: str | None, most: int = 5000) -> list[dict]:
    """family, weight, style, unicode_range and sources of each @font-face rule."""
    text = re.sub(r"/\*.*?(?:\*/|\Z)", " ", value or "", flags=re.S)
    out = []
    for m in _FACE.finditer(text):
        fields: dict[str, str] = {}
        for part in re.findall(r"(?:[^;\"'(]|\"[^\"]*\"|'[^']*'|\([^)]*\))+", m[1]):
            name, colon, v = part.partition(":")
            if colon and "!important" not in v.lower():
                fields[name.strip().lower()] = v.strip()
        family = fields.get("font-family", "").strip().strip("\"'").strip()
        if not family:
            continue
        sources = [{"url": a or b or c or None, "format": (f or None) and f.lower(), "local": local or None} for a, b, c, f, local in _SOURCE.findall(fields.get("src", ""))[:16]]
        out.append({"family": family, "weight": fields.get("font-weight", "normal"), "style": fields.get("font-style", "normal"), "unicode_range": fields.get("unicode-range"), "sources": sources})
        if len(out) >= most:
            break
    return out


def percent_decode(text: str) -> bytes:
    """A lone % stands for itself."""
    return re.sub(rb"%([0-9a-fA-F]{2})", lambda m: bytes([int(m[1], 16)]), text.encode())


def head_tags(page: str | None) -> dict:
    """title, links and metas in the first MiB of a page, comments skipped."""
    text = re.sub(r"<!--.*?(?:-->|\Z)", " ", (page or "")[: 1 << 20], flags=re.S)
    title = re.search(r"<title[^>]*>(.*?)</title", text, re.S | re.I)
    attributes = lambda t: {k.lower(): a or b or c for k, a, b, c in reversed(re.findall(r"""([^\s=/>"']+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", t))}
    links = [attributes(t) for t in re.findall(r"<link\s([^>]{0,16384})>", text, re.I)]
    metas = [attributes(t) for t in re.findall(r"<meta\s([^>]{0,16384})>", text, re.I)]
    icons = [a["href"] for a in links if "icon" in a.get("rel", "").lower() and a.get("href")]
    social = [a["content"] for a in metas if (a.get("property") or a.get("name") or "").lower() in ("og:image", "twitter:image") and a.get("content")]
    return {"title": decode_entities(title[1]).strip() if title else None, "icons": list(dict.fromkeys(icons))[:32], "social": list(dict.fromkeys(social))[:32]}


_ENTITY = re.compile(r"&(?:#(\d{1,7})|#[xX]([0-9a-fA-F]{1,6})|(amp|lt|gt|quot|apos|nbsp));")
_NAMED = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " "}


def decode_entities(text: str) -> str:
    """Six named and all numeric references."""
    point = lambda n: chr(n) if 0 < n < 0x110000 and not 0xD800 <= n < 0xE000 else "\ufffd"
    return _ENTITY.sub(lambda m: _NAMED[m[3]] if m[3] else point(int(m[1]) if m[1] else int(m[2], 16)), text)


def heads(pages: DataFrame) -> DataFrame:
    """page_id, title, icons and social images of each page."""
    reachable(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [head_tags(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([r[k] for r in rows], t) for k, t in (("title", pa.string()), ("icons", pa.list_(pa.string())), ("social", pa.list_(pa.string())))]], ["page_id", "title", "icons", "social"])

    return pages.select(F.col("page_id").cast("long"), "html").mapInArrow(run, "page_id long, title string, icons array<string>, social array<string>")


def links(pages: DataFrame) -> DataFrame:
    """page_id, pos and href of each <a href>, JVM-side."""
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.posexplode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), 1)).alias("pos", "href")).withColumn("pos", F.col("pos").cast("long"))
