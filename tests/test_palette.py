"""Palette clusters against plain loops over colours, and palettes of small pages."""

import math

import numpy as np
import pytest

from pagewright.operators import palette

SAMPLES = "page_id long, source string, hex string, weight double, n long"


def lab(value):
    x = [int(value[i : i + 2], 16) / 255 for i in (1, 3, 5)]
    r, g, b = (v / 12.92 if v <= 0.04045 else ((v + 0.055) / 1.055) ** 2.4 for v in x)
    roots = [math.cbrt(p * r + q * g + s * b) for p, q, s in ((0.4122214708, 0.5363325363, 0.0514459929), (0.2119034982, 0.6806995451, 0.1073969566), (0.0883024619, 0.2817188376, 0.6299787005))]
    out = [sum(p * q for p, q in zip(row, roots, strict=True)) for row in ((0.2104542553, 0.793617785, -0.0040720468), (1.9779984951, -2.428592205, 0.4505937099), (0.0259040371, 0.7827717662, -0.808675766))]
    y = 0.2126 * r + 0.7152 * g + 0.0722 * b
    return (*out, 116 * math.cbrt(y) - 16 if y > 0.008856 else 903.3 * y)


def test_clusters_by_brute_force(spark):
    rng = np.random.default_rng(2)
    sources = ["bg", "text", "cta", "link", "border", "pix"]
    rows = []
    for page in (1, 2):
        for _ in range(120):
            grey = int(rng.integers(256))
            rgb = [grey + int(rng.integers(-2, 3)) for _ in range(3)] if rng.random() < 0.5 else rng.integers(0, 256, 3).tolist()
            rows.append((page, sources[int(rng.integers(6))], "#" + "".join(f"{min(255, max(0, v)):02x}" for v in rgb), float(rng.integers(1, 50)) / 100, 1))
    df = spark.createDataFrame(rows, SAMPLES)
    salient = {(r["page_id"], r["hex"]): r for r in palette.salience(df).collect()}
    want = {}
    for page in (1, 2):
        found = []
        for (p, value), row in sorted(salient.items(), key=lambda x: (-x[1]["salience"], x[0][1])):
            if p != page:
                continue
            l_, a, b, star = lab(value)
            c, h = math.hypot(a, b), math.degrees(math.atan2(b, a)) % 360
            grey = c < (0.075 if l_ < 0.3 else 0.04 if l_ > 0.92 else 0.048)
            assert grey == row["neutral"]
            near = []
            for k, (l2, a2, b2, s2, c2, h2, g2, members) in enumerate(found):
                if g2 != grey:
                    continue
                if grey:
                    d = abs(star - s2)
                    ok = d <= (11 if min(star, s2) < 30 else 2) and abs(c - c2) <= 0.025
                else:
                    d = math.sqrt(((l_ - l2) / 2) ** 2 + (a - a2) ** 2 + (b - b2) ** 2)
                    ok = d <= 0.09 and min(abs(h - h2) % 360, 360 - abs(h - h2) % 360) <= 14
                if ok:
                    near.append((d, k))
            if near:
                found[min(near)[1]][-1].append(value)
            else:
                found.append((l_, a, b, star, c, h, grey, [value]))
        want |= {(page, x[-1][0]): (x[6], len(x[-1])) for x in found}
    got = {(r["page_id"], r["hex"]): (r["neutral"], r["members"]) for r in palette.clusters(palette.salience(df)).collect()}
    assert got == want and any(n > 1 for g, n in want.values() if g) and any(n > 1 for g, n in want.values() if not g)


def test_palette_roles(spark):
    rows = [(1, "bg", "#ffffff", 90.0, 5), (1, "bg", "#f4f4f5", 10.0, 1), (1, "text", "#111111", 80.0, 9), (1, "text", "#777777", 20.0, 3), (1, "cta", "#0047f0", 50.0, 5), (1, "logo", "#0049f2", 10.0, 1), (1, "link", "#0047f0", 9.0, 2), (1, "cta", "#e02020", 8.0, 1), (1, "meta", "#da532c", 1.0, 1)]
    got = {r["hex"]: (r["kind"], r["role"]) for r in palette.build_palettes(spark.createDataFrame(rows, SAMPLES)).collect()}
    assert got["#0047f0"] == ("brand", "primary") and got["#ffffff"] == ("neutral", "background") and got["#111111"] == ("neutral", "text") and "#da532c" not in got
    assert palette.build_palettes(spark.createDataFrame([], SAMPLES)).count() == 0


def test_generated_and_declared_colours(spark):
    rows = [(1, "var", "#00aa55", 0.6, 1), (1, "bg", "#ffffff", 10.0, 1), (1, "var", "#ff8800", 1.0, 1)]
    got = {r["hex"]: r["weight"] for r in palette.build_palettes(spark.createDataFrame(rows, SAMPLES)).filter("kind = 'brand'").collect()}
    assert set(got) == {"#ff8800"}  # a variable alone must be named a brand to count


def test_vivid_pools(spark):
    rows = [(1, "#ff0000", 0.05, 1.0), (1, "#ff3300", 0.02, 1.0), (1, "#00ff00", 0.01, 1.0), (1, "#202020", 0.9, 1.0)]
    got = palette.vivid_pools(spark.createDataFrame(rows, "page_id long, hex string, open_share double, coverage double")).collect()
    assert len(got) == 1 and got[0]["share"] == pytest.approx(0.07) and got[0]["hex"].startswith("#ff")


def test_ring_and_smoothness(spark):
    px = "page_id long, y long, x long, r int, g int, b int, masked boolean"
    rows = [(1, 0, i, 200, 10, 10, False) for i in range(6)] + [(1, 1, i, 40 * i, 0, 0, True) for i in range(4)]
    df = spark.createDataFrame(rows, px)
    assert [r["hex"] for r in palette.ring_color(df).collect()] == ["#c80a0a"]
    assert palette.smoothness(df).first()["smoothness"] == pytest.approx(5 / 8)


def test_page_that_shows_no_colour(spark):
    rows = [(1, "bg", "#ffffff", 9.0, 5), (2, "pix", "#ff0000", 1.0, 1)]
    got = palette.build_palettes(spark.createDataFrame(rows, SAMPLES)).collect()
    assert [(r["page_id"], r["hex"]) for r in got] == [(1, "#ffffff")]


def test_colours_are_not_converted_over_and_over(spark):
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert plan(palette.build_palettes(spark.createDataFrame([(1, "bg", "#ffffff", 9.0, 5)], SAMPLES))).count("conv(") <= 40


def test_palette_of_the_most_salient_colours_alone(spark, monkeypatch):
    monkeypatch.setattr(palette, "MOST_COLORS", 5)
    rng = np.random.default_rng(3)
    rows = [(page, s, f"#{int(v):06x}", float(w), 1) for page in (1, 2) for s in ("bg", "cta", "text", "link") for v, w in zip(rng.integers(0, 1 << 24, 60), rng.integers(1, 99, 60), strict=True)]
    df = spark.createDataFrame(rows, SAMPLES)
    kept = {(r["of_page"], r["of_hex"]) for r in palette._kept(palette.shares(df)).collect()}
    every = sorted(palette.salience(df).collect(), key=lambda r: (-r["salience"], r["hex"]))
    assert kept == {(p, r["hex"]) for p in (1, 2) for r in [x for x in every if x["page_id"] == p][:5]}
    assert all(set(r["variants"].split(",")) <= {h for p, h in kept if p == r["page_id"]} for r in palette.build_palettes(df).collect())
