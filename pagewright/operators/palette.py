"""Palettes: sample shares in SQL, then one page's most salient colours (a bounded number) are clustered, scored and given roles in one group."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import color
from ..session import reachable

#: Most salient colours of a page that are clustered.
MOST_COLORS = 1500
#: Parts of a page that its most salient colours are first sought in.
PARTS = 16
# Fixed values.
BRAND_WEIGHTS = {"swatch": 3.0, "cta": 3.0, "logo": 2.0, "icon": 1.0, "meta": 1.0, "var": 1.5, "link": 1.0, "bg": 1.0, "text": 0.5, "grad": 0.5, "svg": 0.5, "border": 0.3, "shot": 0.8}
NEUTRAL_WEIGHTS = {"bg": 1.0, "text": 1.0, "pix": 0.6, "border": 0.15, "cta": 0.3, "svg": 0.1, "logo": 0.2}
SOURCES = [*BRAND_WEIGHTS, "pix"]
EVIDENCE = {"declared": ("var", "meta", "icon"), "identity": ("logo", "swatch"), "action": ("cta",), "content": ("text", "link", "svg", "border"), "surface": ("bg", "grad"), "pixels": ("shot",)}
PAINTED = ("bg", "text", "border", "svg", "cta", "link", "grad", "logo", "swatch")
GENERATED = "#da532c #2b5797 #00aba9 #2d89ef #b91d47 #9f00a7 #603cba #ffc40d #ee1111 #00a300 #1e7145 #7e3878 #5bbad5".split()
DISTANCE, HUE, DARK_STEP, LIGHT_STEP, DARK, CHROMA_STEP = 0.09, 14.0, 11.0, 2.0, 30.0, 0.025
MOST_BRAND, MOST_NEUTRAL, LEAST_SHARE = 6, 4, 0.004


def aggregated(samples: DataFrame) -> DataFrame:
    """page_id, source, hex, weight and n, summed; what favicon generators write into meta tags is no sample."""
    return samples.filter(~((F.col("source") == "meta") & F.lower("hex").isin(GENERATED))).groupBy("page_id", "source", "hex").agg(F.sum("weight").alias("weight"), F.sum("n").alias("n"))


def shares(samples: DataFrame) -> DataFrame:
    """Each sample's share of its source on the page; screenshot weights (shot, pix) are shares of the picture already."""
    summed = aggregated(samples)
    totals = summed.groupBy(F.col("page_id").alias("of_page"), F.col("source").alias("of_source")).agg(F.sum("weight").alias("total"))
    share = F.when(F.col("source").isin("shot", "pix"), F.col("weight")).otherwise(F.col("weight") / F.col("total"))
    return summed.join(totals, F.col("page_id").eqNullSafe(F.col("of_page")) & F.col("source").eqNullSafe(F.col("of_source"))).withColumn("share", share).drop("of_page", "of_source", "total")


def _weighed(weights: dict[str, float]):
    value = F.lit(0.0)
    for name, w in weights.items():
        value = F.when(F.col("source") == name, w).otherwise(value)
    return F.sum(F.col("share") * value)


def salience(samples: DataFrame) -> DataFrame:
    """page_id, hex, its OKLab and L*, whether it is neutral, its share by source (in SOURCES' order), and its salience: the shares weighed for its kind.

    Colours are converted once for each distinct one, with their parts as columns."""
    return _salience(shares(samples))


def _salience(shared: DataFrame) -> DataFrame:
    by_color = shared.groupBy("page_id", "hex").agg(_weighed(BRAND_WEIGHTS).alias("as_brand"), _weighed(NEUTRAL_WEIGHTS).alias("as_neutral"), F.array(*[F.sum(F.when(F.col("source") == s, F.col("share")).otherwise(0.0)) for s in SOURCES]).alias("shares"), F.max(F.when(F.col("source") == "var", F.col("weight")).otherwise(0.0)).alias("var_name"))
    known = color.with_oklab(shared.select("hex").distinct()).withColumn("lstar", color.lstar(F.col("hex")))
    hue = F.degrees(F.atan2("b", "a"))
    known = known.withColumn("c", F.hypot("a", "b")).withColumn("h", F.when(hue < 0, hue + 360).otherwise(hue)).withColumn("neutral", color.is_neutral(F.col("l"), F.col("c")))
    return by_color.join(known, "hex").withColumn("salience", F.when(F.col("neutral"), F.col("as_neutral")).otherwise(F.col("as_brand"))).drop("as_brand", "as_neutral")


def histogram(samples: DataFrame) -> DataFrame:
    """page_id, bin (15 bits), n and its share of the page."""
    counted = samples.groupBy("page_id", color.bin5(F.col("hex")).alias("bin")).agg(F.sum("n").alias("n"))
    return counted.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("page_id")))


def pixel_histogram(pixels: DataFrame, bits: int = 5) -> DataFrame:
    """page_id, bin, hex (the mean of the bin), share of all pixels and of those outside masked media; and coverage, the share that is outside."""
    step = 8 - bits
    r, g, b = (F.shiftright(F.col(x), step) for x in ("r", "g", "b"))
    key = (F.shiftleft(r, 2 * bits) + F.shiftleft(g, bits) + b).cast("long")
    open_ = F.col("masked") == F.lit(False)
    bins = pixels.groupBy("page_id", key.alias("bin")).agg(*[F.avg(x).alias(x) for x in ("r", "g", "b")], F.count(F.lit(1)).alias("n"), F.count_if(open_).alias("n_open"))
    page = Window.partitionBy("page_id")
    two = lambda x: F.lpad(F.lower(F.hex(F.floor(F.col(x) + 0.5).cast("long"))), 2, "0")
    out = bins.withColumn("all", F.sum("n").over(page)).withColumn("open", F.sum("n_open").over(page))
    return out.select("page_id", "bin", F.concat(F.lit("#"), two("r"), two("g"), two("b")).alias("hex"), (F.col("n") / F.col("all")).alias("share"), F.when(F.col("open") > 0, F.col("n_open") / F.col("open")).otherwise(0.0).alias("open_share"), (F.col("open") / F.col("all")).alias("coverage"))


def ring_color(pixels: DataFrame, least: float = 0.4) -> DataFrame:
    """page_id and hex of the commonest bin of a band of pixels, where it has ``least`` of them; the first bin on a tie."""
    bins = pixel_histogram(pixels.withColumn("masked", F.lit(False)))
    best = Window.partitionBy("page_id").orderBy(F.desc("share"), "bin")
    return bins.withColumn("at", F.row_number().over(best)).filter((F.col("at") == 1) & (F.col("share") >= least)).select("page_id", "hex")


def smoothness(pixels: DataFrame, step: int = 1, most: int = 6) -> DataFrame:
    """page_id and the share of neighbours in a row that differ by ``most`` or less in every channel; 0 without a pair.  ``pixels`` has page_id, y, x, r, g, b.

    A picture's row is a partition, so a picture is no single task."""
    row = Window.partitionBy("page_id", "y").orderBy("x")
    near = F.greatest(*[F.abs(F.lead(c, step).over(row) - F.col(c)) for c in ("r", "g", "b")]) <= most
    return pixels.withColumn("near", near.cast("double")).groupBy("page_id").agg(F.coalesce(F.avg("near"), F.lit(0.0)).alias("smoothness"))


def without_blends(colors: DataFrame, anchors: int = 4) -> DataFrame:
    """``colors`` (page_id, hex, share) without those that lie between two of the page's commonest and are rarer than both: the edges that smoothing draws.

    Every colour meets the pairs of at most ``anchors`` others."""
    channels = [c.cast("double") for c in color.channels(F.col("hex"))]
    points = colors.withColumn("p", F.array(*channels))
    top = points.withColumn("at", F.row_number().over(Window.partitionBy("page_id").orderBy(F.desc("share"), "hex"))).filter(F.col("at") <= anchors).select("page_id", "at", "p", "share")
    one, two = (top.select("page_id", *[F.col(c).alias(f"{c}{i}") for c in ("at", "p", "share")]) for i in (1, 2))
    pairs = one.join(two, "page_id").filter("at1 < at2")
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda s, t: s * t), F.lit(0.0), lambda s, v: s + v)
    minus = lambda x, y: F.zip_with(x, y, lambda s, t: s - t)
    pairs = pairs.withColumn("d", minus("p2", "p1")).withColumn("d2", dot("d", "d")).filter("d2 >= 900")
    tried = points.join(F.broadcast(pairs), "page_id").filter(F.col("share") < F.least("share1", "share2")).withColumn("from", minus("p", "p1")).withColumn("t", dot("from", "d") / F.col("d2"))
    off = dot("from", "from") - F.col("t") * F.col("t") * F.col("d2")
    blends = tried.filter((F.col("t") > 0.06) & (F.col("t") < 0.94) & (off < 500)).select("page_id", "hex").distinct()
    return colors.join(blends, ["page_id", "hex"], "left_anti")


def vivid_pools(bins: DataFrame, least: float = 0.04) -> DataFrame:
    """page_id, place, hex and share of the hues that a page shows in vivid pixels: 18 buckets of 20 degrees; a peak takes the neighbours that no larger peak took.

    ``bins`` has page_id, hex and open_share, coverage.  The fold runs over 18 sums of a page."""
    lightness, a, b = color.oklab(F.col("hex"))
    hue = F.degrees(F.atan2(b, a))
    vivid = bins.select("*", lightness.alias("l"), F.hypot(a, b).alias("c"), ((F.floor(F.when(hue < 0, hue + 360).otherwise(hue) / 20 + 0.5)) % 18).cast("int").alias("k")).filter("c >= 0.12 and l >= 0.3")
    w = F.col("open_share") * F.col("c") * F.col("c")
    r, g, b = color.channels(F.col("hex"))
    sums = vivid.groupBy("page_id", "k").agg(F.sum("open_share").alias("share"), F.first("coverage").alias("coverage"), F.sum(w).alias("w"), F.sum(w * r).alias("r"), F.sum(w * g).alias("g"), F.sum(w * b).alias("b"))
    reachable(bins.sparkSession)

    def pool(rows: pd.DataFrame) -> pd.DataFrame:
        left = {int(x.k): x for x in rows.itertuples()}
        out = []
        for k in sorted(left, key=lambda k: (-left[k].share, k)):
            if k not in left or left[k].share * left[k].coverage < 0.003:
                continue
            group = [left.pop(j) for j in (k, (k + 17) % 18, (k + 1) % 18) if j in left]
            share = sum(x.share for x in group) * group[0].coverage
            if share >= least:
                weight = sum(x.w for x in group)
                out.append((group[0].page_id, len(out), "#" + "".join(f"{int(sum(getattr(x, c) for x in group) / weight + 0.5):02x}" for c in "rgb"), share))
        return pd.DataFrame(out, columns=["page_id", "place", "hex", "share"])

    return sums.groupBy("page_id").applyInPandas(pool, "page_id long, place long, hex string, share double")


def hue_apart(a: np.ndarray, b: float) -> np.ndarray:
    turn = np.abs(a - b) % 360
    return np.minimum(turn, 360 - turn)


def step_between(a: np.ndarray | float, b: np.ndarray | float) -> np.ndarray:
    """How far apart in L* two neutrals may be and still be one."""
    return np.where(np.minimum(a, b) < DARK, DARK_STEP, LIGHT_STEP)


class Clusters:
    """One page's colours, most salient first, in clusters: each joins the nearest one of its kind in reach of that one's first colour, or starts one."""

    def __init__(self, rows: pd.DataFrame):
        self.rows = rows = rows.sort_values(["salience", "hex"], ascending=[False, True]).reset_index(drop=True)
        self.hex = rows["hex"].to_numpy()
        self.shares = np.vstack(rows["shares"].to_numpy()) if len(rows) else np.empty((0, len(SOURCES)))
        lab = rows[["l", "a", "b"]].to_numpy(float) * np.array([0.5, 1.0, 1.0])
        c, h, lstar, neutral = (rows[x].to_numpy() for x in ("c", "h", "lstar", "neutral"))
        heads: list[int] = []
        self.members: list[list[int]] = []
        for i in range(len(rows)):
            at = np.array(heads, int)
            if neutral[i]:
                away = np.abs(lstar[at] - lstar[i])
                near = neutral[at].astype(bool) & (away <= step_between(lstar[at], lstar[i])) & (np.abs(c[at] - c[i]) <= CHROMA_STEP)
            else:
                away = np.sqrt(((lab[at] - lab[i]) ** 2).sum(1))
                near = ~neutral[at].astype(bool) & (away <= DISTANCE) & (hue_apart(h[at], h[i]) <= HUE)
            if near.any():
                self.members[int(np.argmin(np.where(near, away, np.inf)))].append(i)
            else:
                heads.append(i)
                self.members.append([i])
        self.total = np.array([self.shares[m].sum(0) for m in self.members]).reshape(-1, len(SOURCES))
        self.neutral = neutral[heads].astype(bool)
        self.head = np.array(heads, int)
        self.pixels = bool(self.shares[:, SOURCES.index("pix")].any()) if len(rows) else False

    def of(self, *sources: str) -> np.ndarray:
        return self.total[:, [SOURCES.index(s) for s in sources]].sum(1)

    def elect(self) -> None:
        """A neutral cluster is shown by the member with most of its weightiest source; for backgrounds, one that the page's own styles have, with the pixels near it."""
        weights = np.array([NEUTRAL_WEIGHTS.get(s, 0.0) for s in SOURCES])
        bg, pix = SOURCES.index("bg"), SOURCES.index("pix")
        rgb = np.array([[int(x[i : i + 2], 16) for i in (1, 3, 5)] for x in self.hex])
        for k, m in enumerate(self.members):
            if not self.neutral[k] or len(m) < 2:
                continue
            strength = np.where(self.total[k] > 0, weights * self.total[k], -1.0)
            main = int(np.argmax(strength)) if strength.max() > 0 else bg
            at = np.array(m)
            key = self.shares[at, main].copy()
            if main == bg and self.pixels:
                near = (np.abs(rgb[at][:, None] - rgb[at][None]) <= 3).all(2)
                key = np.where(key > 0, key + near @ self.shares[at, pix], -1.0)
            best = int(np.argmax(key))
            m.insert(0, m.pop(best))
            self.head[k] = m[0]

    def score(self) -> None:
        """Weighed shares; a brand colour counts more with each independent source, less if nothing paints it, and less if it is dull."""
        rows, h = self.rows, self.head
        self.c, self.h, self.l, self.lstar = (rows[x].to_numpy(float)[h] for x in ("c", "h", "l", "lstar"))
        self.var_name = np.array([rows["var_name"].to_numpy(float)[m].max() for m in self.members])
        self.seen = self.total > LEAST_SHARE
        self.painted = self.seen[:, [SOURCES.index(s) for s in PAINTED]].any(1)
        plain = self.total @ np.array([NEUTRAL_WEIGHTS.get(s, 0.0) for s in SOURCES])
        sources = np.delete(self.seen, SOURCES.index("pix"), 1).sum(1)
        only_var = (sources == 1) & self.seen[:, SOURCES.index("var")]
        unpainted = np.where(only_var, np.select([self.var_name >= 1, self.var_name >= 0.8], [0.4, 0.15], 0.0), 0.5)
        brand = self.total @ np.array([BRAND_WEIGHTS.get(s, 0.0) for s in SOURCES]) * (1 + 0.2 * np.clip(sources - 1, 0, 5)) * np.where(self.painted, 1.0, unpainted) * np.where(self.c < 0.08, 0.6, 1.0)
        self.scores = np.where(self.neutral, plain, brand)
        lead = self._by_score(~self.neutral)[:1]
        if len(lead) and self.scores[lead[0]] >= 0.3:
            # A dark surface in the lead's hue that is on screen is a shade of the brand.
            surface = self.of("bg", "cta")
            shade = self.neutral & (self.c >= 0.03) & (self.l <= 0.6) & (hue_apart(self.h, self.h[lead[0]]) <= 20) & (self.of("pix") >= 0.02) & (surface >= 0.1) & (surface >= self.of("text"))
            self.neutral, self.scores = self.neutral & ~shade, np.where(shade, brand, self.scores)

    def _by_score(self, which: np.ndarray) -> list[int]:
        return sorted(np.flatnonzero(which).tolist(), key=lambda k: -self.scores[k])

    def brands(self) -> list[int]:
        """The brand colours: scored well enough, seen or painted if the lead is, with evidence of two kinds or strong of one; printed swatches first."""
        order = self._by_score(~self.neutral)
        if not order:
            return []
        lead = order[0]
        kinds = sum(self.seen[:, [SOURCES.index(s) for s in of]].any(1).astype(int) for of in EVIDENCE.values())
        shown = self.painted | (self.of("shot") >= 0.01)
        backed = (kinds >= 2) | (self.scores >= 0.2) | (self.var_name >= 1) | ((self.of("shot") >= 0.04) & (self.c >= 0.12))
        fits = (self.scores >= 0.1) & (self.scores >= 0.02 * self.scores[lead]) & backed & (shown | (not shown[lead]) | (np.arange(len(self.scores)) == lead))
        return sorted((k for k in order if fits[k]), key=lambda k: -self.of("swatch")[k])[:MOST_BRAND]

    def neutrals(self, coverage: float = 1.0) -> tuple[list[int], dict[int, str]]:
        """Background, text, what fills the screen, a second surface, quiet text, and what is far enough from those; and the roles of the first two."""
        order = self._by_score(self.neutral & (self.scores >= 0.02))
        ground, text, pix = self.of("bg") + 0.5 * self.of("pix"), self.of("text"), self.of("pix")
        lum = np.array([_luminance(self.hex[k]) for k in self.head])
        picked: list[int] = []
        roles: dict[int, str] = {}

        def best(rule: Callable[[int], bool], key: Callable[[int], float]) -> int | None:
            fit = [k for k in order if k not in picked and rule(k)]
            return max(fit, key=key) if fit else None

        def far(k: int, least: float = 0.0) -> bool:
            return all(abs(self.lstar[p] - self.lstar[k]) >= max(least, float(step_between(self.lstar[p], self.lstar[k]))) for p in picked)

        def contrast(a: int, b: int) -> float:
            return (max(lum[a], lum[b]) + 0.05) / (min(lum[a], lum[b]) + 0.05)

        page = best(lambda k: True, lambda k: ground[k])
        if page is not None and ground[page] >= 0.2:
            picked.append(page)
            rest = max([0.0, *(ground[k] for k in order if k != page)])
            on_screen = not self.pixels or coverage < 0.2 or pix[page] >= 0.1
            if on_screen and ground[page] >= 0.35 and ground[page] >= 1.3 * rest:
                roles[page] = "background"
        most = max([0.0, *(text[k] for k in order if k not in picked)])
        words = best(lambda k: text[k] > 0 and text[k] >= 0.5 * most and contrast(k, page) >= 3, lambda k: contrast(k, page) + text[k])
        if words is not None and text[words] >= 0.03:
            picked.append(words)
            if text[words] >= 0.2:
                roles[words] = "text"
        slots = MOST_NEUTRAL
        if self.pixels:
            wide = best(lambda k: pix[k] * coverage >= 0.2 and all(abs(self.lstar[p] - self.lstar[k]) >= 8 for p in picked), lambda k: pix[k])
            if wide is not None:
                picked.append(wide)
                slots += 1
        for rule, key in ((lambda k: ground[k] >= 0.04 and far(k, 2), lambda k: ground[k]), (lambda k: text[k] >= 0.05 and far(k, 8), lambda k: text[k])):
            more = best(rule, key)
            if more is not None:
                picked.append(more)
        for k in order:
            if len(picked) < slots and k not in picked and far(k):
                picked.append(k)
        return picked[:slots], roles

    def brand_roles(self, brands: list[int]) -> dict[int, str]:
        roles: dict[int, str] = {}
        if brands:
            p = brands[0]
            backed = self.of("cta", "logo", "link")[p] > 0.01 or self.of("var", "meta", "icon", "swatch")[p] > 0.05
            clear = len(brands) == 1 or self.scores[p] >= 1.25 * self.scores[brands[1]]
            if backed and self.scores[p] >= 0.3 and clear:
                roles[p] = "primary"
            roles |= {k: "accent" for k in brands if k not in roles and self.scores[k] >= 0.2 and self.painted[k]}
        return roles


def _luminance(value: str) -> float:
    x = np.array([int(value[i : i + 2], 16) for i in (1, 3, 5)]) / 255
    return float(np.where(x <= 0.04045, x / 12.92, ((x + 0.055) / 1.055) ** 2.4) @ [0.2126, 0.7152, 0.0722])


_COLUMNS = ["page_id", "hex", "l", "a", "b", "c", "h", "lstar", "neutral", "shares", "var_name", "salience"]


def _most_salient(salient: DataFrame) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("page_id").orderBy(F.desc("salience"), "hex"))
    return salient.withColumn("place", place).filter(F.col("place") <= MOST_COLORS).select(*_COLUMNS)


def _kept(shared: DataFrame) -> DataFrame:
    """of_page and of_hex of each page's MOST_COLORS most salient colours, in narrow rows: first of each of PARTS parts of a page, so a large page is no single task, then of what these leave."""
    neutral = color.is_neutral(F.col("l"), F.hypot("a", "b"))
    by_color = shared.filter("hex IS NOT NULL").groupBy("page_id", "hex").agg(_weighed(BRAND_WEIGHTS).alias("as_brand"), _weighed(NEUTRAL_WEIGHTS).alias("as_neutral"))
    left = color.with_oklab(by_color).select("page_id", "hex", F.when(neutral, F.col("as_neutral")).otherwise(F.col("as_brand")).alias("salience"), F.pmod(F.xxhash64("hex"), F.lit(PARTS)).alias("part"))
    for by in (("page_id", "part"), ("page_id",)):
        left = left.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("salience"), "hex"))).filter(F.col("place") <= MOST_COLORS)
    return left.select(F.col("page_id").alias("of_page"), F.col("hex").alias("of_hex"))


def clusters(salient: DataFrame) -> DataFrame:
    """page_id, hex (what shows the cluster), neutral, members and salience."""
    reachable(salient.sparkSession)

    def group(rows: pd.DataFrame) -> pd.DataFrame:
        found = Clusters(rows)
        first = found.head.copy()
        found.elect()
        s = found.rows["salience"].to_numpy(float)
        return pd.DataFrame({"page_id": rows["page_id"].iloc[0], "hex": found.hex[first], "shown": found.hex[found.head], "neutral": found.neutral, "members": [len(m) for m in found.members], "salience": [s[m].sum() for m in found.members]})

    return _most_salient(salient).groupBy("page_id").applyInPandas(group, "page_id long, hex string, shown string, neutral boolean, members long, salience double")


def build_palettes(samples: DataFrame, coverage: float = 1.0) -> DataFrame:
    """page_id, place, hex, kind (brand or neutral), role, weight, variants and confidence of each page's palette: brand colours, then neutrals."""
    shared = shares(samples)
    kept = shared.join(_kept(shared), F.col("page_id").eqNullSafe(F.col("of_page")) & (F.col("hex") == F.col("of_hex")), "left_semi")
    reachable(samples.sparkSession)

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        found = Clusters(rows)
        found.elect()
        found.score()
        brands = found.brands()
        plain, roles = found.neutrals(coverage)
        roles |= found.brand_roles(brands)
        lead = next((k for k in brands if roles.get(k) == "primary"), None)
        sure = ("high" if found.seen[lead].sum() >= 3 else "medium") if lead is not None else "low" if brands else "medium"
        shown = [*brands, *plain]
        out = pd.DataFrame({
            "page_id": rows["page_id"].iloc[0], "place": range(len(shown)), "hex": [found.hex[found.head[k]] for k in shown], "kind": ["brand"] * len(brands) + ["neutral"] * len(plain),
            "role": [roles.get(k) for k in shown], "weight": [round(float(found.scores[k]), 4) for k in shown], "variants": [",".join(found.hex[m] for m in found.members[k][:6]) for k in shown], "confidence": sure,
        })
        return out.astype(dict.fromkeys(("hex", "kind", "role", "variants", "confidence"), object))  # a page that shows no colour has text columns too

    return _salience(kept).select(*_COLUMNS).groupBy("page_id").applyInPandas(build, "page_id long, place long, hex string, kind string, role string, weight double, variants string, confidence string")
