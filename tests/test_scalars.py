"""Column rules against written-out cases."""

import base64
import hashlib

import pytest
from pyspark.sql import functions as F

from pagewright.functions import labels, pictures, urls


def check(spark, function, cases, types="string"):
    """``function`` of columns a, b, ... against the last value of each case."""
    n = len(cases[0]) - 1
    names = "abcdefgh"[:n]
    kinds = types.split(",") if "," in types else [types] * n
    rows = [(i, *case[:-1]) for i, case in enumerate(cases)]
    df = spark.createDataFrame(rows, "i long, " + ", ".join(f"{c} {t.strip()}" for c, t in zip(names, kinds, strict=True)))
    got = {r["i"]: r["out"] for r in df.select("i", function(*map(F.col, names)).alias("out")).collect()}
    for i, case in enumerate(cases):
        value = got[i].asDict() if hasattr(got[i], "asDict") else got[i]
        assert value == case[-1], (case, value)


def test_typed_urls(spark):
    check(spark, urls.typed_url, [
        ("linear.app", "https://linear.app/"), ("<https://x.com>.", "https://x.com/"), ('"linear.app",', "https://linear.app/"), ("(see x.com/a_(b))", None), ("x.com/a_(b))", "https://x.com/a_(b)"), ("x.com/a_(b).)", "https://x.com/a_(b)"),
        ("HTTP://User:pw@Www.X.com:80/A?b=1#frag", "http://www.x.com/A?b=1"), ("x.com/#/route", "https://x.com/#/route"), ("x.com:8080", None), ("ftp://x.com", None), ("x y.com", None), ("", None), ("localhost:443", "https://localhost/"), ("nodots", None), ("x.com./a", "https://x.com/a"), (None, None),
    ])


def test_links(spark):
    check(spark, urls.is_home, [("/", "https://a.com/x", True), ("/en-gb/", "https://a.com/x", True), ("https://www.a.com", "https://a.com/x", True), ("https://b.com/", "https://a.com/", False), ("#top", "https://a.com/", False), ("/about", "https://a.com/", False), (None, "https://a.com/", False)])
    check(spark, urls.link_key, [("https://u@A.com/cp/#x", "https://a.com/cp"), ("https://a.com", "https://a.com/"), ("https://a.com/?q=1", "https://a.com/?q=1")])
    check(spark, urls.is_brand_word, [("/OurBrand", True), ("/wordpress", False), ("Press kit", True), ("/pressure", False), ("/logout", False), ("logopack", True)])
    check(spark, urls.is_strong_brand, [("Brand Kit", True), ("Press", False), ("Download the Media Kit", True), ("visual identity", True)])
    check(spark, urls.has_logo_word, [("site-logo", True), ("logout", False), ("text-brand", False), ("navbar brand", True), ("bg-brand/80", False), ("Wordmark", True)])
    check(spark, urls.is_brand_portal, [("https://acme.frontify.com/d/x", True), ("https://brandfolder.com/acme", True), ("https://www.frontify.com/", False), ("https://x.com/frontify.com", False)])
    check(spark, urls.brand_file_type, [("kit.ZIP ", "zip"), ("logo.svg", "svg"), ("a.txt", None)])
    check(spark, urls.is_generic_label, [("DOWNLOAD PNG + SVG", True), ("Get the ZIP (2 MB)", True), ("Logo pack", False), ("", True)])
    check(spark, urls.is_public_ipv4, [("8.8.8.8", True), ("10.1.2.3", False), ("172.20.0.1", False), ("192.168.1.1", False), ("169.254.169.254", False), ("100.64.0.1", False), ("224.0.0.1", False), ("256.1.1.1", None), ("x", None)])


def test_sizes(spark):
    check(spark, pictures.largest_icon_size, [("16x16 32X32 any", {"width": 32, "height": 32}), ("any", None), ("123456x10 8x8", {"width": 8, "height": 8}), (None, None), ("4x9 6x6", {"width": 4, "height": 9})])
    check(spark, pictures.svg_size, [('<svg width="24px" height=\'12\'>', {"width": 24.0, "height": 12.0}), ('<svg width="100%" viewBox="0 0 30,40">', {"width": 30.0, "height": 40.0}), ("<svg>", None), (None, None)])


def test_data_uris(spark):
    check(spark, pictures.data_uri, [("data:,a%20b%", {"mime": "text/plain", "bytes": bytearray(b"a b%")}), ("data:Image/PNG;base64,AAEC", {"mime": "image/png", "bytes": bytearray(b"\0\1\2")}), ("data:image/svg+xml;utf8,<svg>+</svg>", {"mime": "image/svg+xml", "bytes": bytearray(b"<svg>+</svg>")}), ("data:x;base64,AA", {"mime": "x", "bytes": bytearray(b"\0")}), ("http://x", None), (None, None)])


def test_sniffing(spark):
    ftyp = b"\0\0\0\x1cftypmif1\0\0\0\0mif1avif"
    check(spark, pictures.sniffed_format, [
        (b"\x89PNG\r\n\x1a\n..", "png"), (b"\xff\xd8\xff\xe0", "jpg"), (b"GIF89a..", "gif"), (b"RIFF0000WEBP", "webp"), (ftyp, "avif"), (b"\0\0\1\0\1\0..", "ico"), (b"\0\0\1\0\0\0", "other"), (b"BM" + b"0" * 10, "bmp"),
        (b"\xef\xbb\xbf <?xml version='1.0'?><!-- x --><!DOCTYPE svg [<!ENTITY a 'b'>]><svg ", "svg"), (b"<html><svg>", "other"), (b"", "other"), (None, "other"), (b"wOF2", "other"),
    ], "binary")
    check(spark, pictures.sniffed_type, [(b"wOF2....", "font/woff2"), (b"OTTO", "font/otf"), (b"true", "font/ttf"), (b"\0\1\0\0", "font/ttf"), (b"x", None)], "binary")


def test_svg_rules(spark):
    check(spark, pictures.is_sprite_sheet, [("<svg><symbol><path/></symbol></svg>", True), ("<svg><symbol><path/></symbol><path/></svg>", False), ("<svg><path/></svg>", False), ("<svg><defs><path/></defs><symbol/></svg>", True)])
    check(spark, pictures.normal_hex, [("#FA0", "#ffaa00"), ("fa08", "#ffaa00"), ("#12345678", "#123456"), ("#12345", None), (" #ABCDEF ", "#abcdef"), (None, None)])
    check(spark, lambda m: pictures.svg_colors(m)["hex"], [('<path fill="#FFF" stroke=red style="fill: rgb(1, 2.6,300)"/><path fill="#fff"/>', ["#ffffff", "#0103ff"]), ("<path/>", ["#000000"]), ("<g/>", [])])
    check(spark, lambda m: pictures.svg_colors(m)["weight"], [('<path fill="#FFF"/><path fill=black /><path fill="#fff"/><path fill="white"/>', [750.0, 250.0])])
    check(spark, pictures.canonical_svg, [('<svg viewBox="0 0 1 1" width="4" height="5"><g id=":R1:"/><use href="#:R1:" fill="url(#b)"/></svg>', '<svg viewBox="0 0 1 1"><g id="i0"/><use href="#i0" fill="url(#i1)"/></svg>'), ('<svg width="4"/>', '<svg width="4"/>'), (None, None)])


def test_fingerprints(spark):
    a, b = hashlib.sha256(b"a").hexdigest(), hashlib.sha256(b"b").hexdigest()
    bits = bin(int(a, 16) ^ int(b, 16)).count("1")
    check(spark, pictures.hamming, [(a, a, 0), (a, b, bits), (a, "zz", 256), (a, None, 256)])
    check(spark, pictures.rmse, [([1, 2], [4, 6], pytest.approx(12.5**0.5)), ([], [], 255.0), ([1], [1, 2], 255.0)], "array<int>")
    check(spark, pictures.tone, [(4, 4.0, 1.0, "opaque"), (4, 2.0, 1.8, "light"), (4, 2.0, 0.2, "dark"), (4, 2.0, 1.0, "mixed"), (0, 0.0, 0.0, "unknown")], "long, double, double")


def test_labels(spark):
    check(spark, labels.duration, [(400, "0s"), (59_600, "1m 0s"), (125_000, "2m 5s")], "long")
    check(spark, labels.badge, [("logo", "logos", None), ("logo", "images", "Logo"), ("social", "images", "OG image"), ("icon", "images", None)])
    check(spark, labels.safe_host, [("WWW.Exa mple.com", "exa-mple.com"), ("..", "site"), ("a..b", "a.b")])
    check(spark, labels.written_name, [("../../evil.svg", "id1", "png", "evil.png"), ("", "id1", "other", "id1.bin"), ("Open me.terminal", "x", "png", "Open me.png"), ("noext", "x", "jpg", "noext.jpg")])
    check(spark, lambda w, h: labels.dimensions(w, h), [(10.4, 20.5, "10×21"), (0.0, 3.0, ""), (None, 3.0, None and "")][:2], "double")
    rows = [(1, "tracker", 5), (1, "pixel", 4), (1, "consent", 1), (1, "spacer", 2), (1, "widget", 1), (1, "new", 1), (2, "tracker", 1), (3, "x", 1), (4, "tracker", 0)]
    got = {r["page_id"]: r["summary"] for r in labels.hidden_summary(spark.createDataFrame(rows, "page_id long, reason string, n long")).collect()}
    assert got == {1: "14 hidden: tracking pixels, spacer images, a consent banner and other files", 2: "1 hidden: a tracking pixel", 3: "1 hidden: another file"}


def test_data_uri_bytes_match_python(spark):
    raw = bytes(range(256)) * 3
    check(spark, lambda u: pictures.data_uri(u)["bytes"], [("data:;base64," + base64.b64encode(raw).decode(), bytearray(raw))])
