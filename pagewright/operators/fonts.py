"""Font families of pages: rules, captured files, loaded faces and text usage become named families with sources and shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import font_names, rules

#: Undeclared names of a page that are compared with its registered families, and those families.
MOST_NAMES, MOST_FAMILIES = 128, 128
INSTALLABLE, NATIVE = ("woff2", "woff", "ttf", "otf"), ("ttf", "otf")


def captured_fonts(fonts: DataFrame) -> DataFrame:
    """The first good response of each URL of a page, with the name that the file gives itself."""
    good = fonts.filter(F.col("status").between(200, 299))
    first = Window.partitionBy("page_id", "url").orderBy("seq")
    name = font_names.binary_family(*[F.col(c) for c in ("typographic", "wws", "legacy", "postscript")])
    return good.withColumn("n", F.row_number().over(first)).filter("n = 1").drop("n").withColumn("binary", name)


def _key(weight="weight", style="style", stretch="stretch", family="family") -> Column:
    return font_names.face_key(F.col(family), F.col(weight), F.col(style), F.col(stretch))


def rule_files(face_rules: DataFrame, captured: DataFrame, statuses: DataFrame) -> DataFrame:
    """One file for each @font-face rule: its first source that was captured, else the best format; and whether the face is loaded.

    ``face_rules`` has a row for each source (rule, pos, url, format)."""
    got = captured.select("page_id", "url", "binary", "covers_latin", F.lit(True).alias("captured"))
    entries = face_rules.join(got, ["page_id", "url"], "left").withColumn("captured", F.coalesce("captured", F.lit(False)))
    order = F.struct((~F.col("captured")).cast("int"), F.when(F.col("captured"), 0).otherwise(font_names.format_rank(F.col("format"))), "pos")
    picked = entries.groupBy("page_id", "rule", "family", "weight", "style", "stretch", "unicode_range").agg(F.min_by(F.struct("url", "format", "captured", "binary", "covers_latin"), order).alias("x"))
    loaded = statuses.filter("status = 'loaded'").select("page_id", _key().alias("face"), F.lit(True).alias("status_loaded")).distinct()
    out = picked.select("page_id", "rule", "family", "weight", "style", "stretch", "unicode_range", "x.*").withColumn("face", _key()).join(loaded, ["page_id", "face"], "left")
    latin = rules.covers_latin(F.col("unicode_range")) & F.coalesce("covers_latin", F.lit(True))
    return out.withColumn("covers_latin", latin).withColumn("loaded", F.col("captured") | F.coalesce("status_loaded", F.lit(False))).drop("status_loaded")


def registered(statuses: DataFrame, face_rules: DataFrame) -> DataFrame:
    """page_id, family of the loaded families that no rule declares."""
    family = F.lower("family").alias("key")
    names = statuses.filter("status = 'loaded'").groupBy("page_id", family).agg(F.min("family").alias("family")).filter(~F.col("key").isin(*font_names.GENERIC))
    return names.join(face_rules.select("page_id", family).distinct(), ["page_id", "key"], "left_anti")


def claims(names: DataFrame, families: DataFrame) -> DataFrame:
    """page_id, binary, family: the registered families that stand for one undeclared name and for no other.

    Names and families of a page are compared up to 128 of each, as a page's script decides on their number."""
    at = lambda df, c, n: df.withColumn("n", F.row_number().over(Window.partitionBy("page_id").orderBy(c))).filter(F.col("n") <= n).drop("n")
    pairs = at(names, "binary", MOST_NAMES).join(at(families, "key", MOST_FAMILIES), "page_id")
    same = pairs.filter(F.lower(font_names.shown_family(F.col("binary"), F.col("family"))["name"]) == F.lower("binary"))
    groups = same.groupBy("page_id", "key").agg(F.count_distinct(F.lower("binary")).alias("groups")).filter("groups = 1")
    return same.join(groups, ["page_id", "key"], "left_semi").select("page_id", "binary", "family")


def grouped_files(face_rules: DataFrame, fonts: DataFrame, statuses: DataFrame) -> DataFrame:
    """Every file of a page with its group: css:, the cleaned family of its rule; bin:, its own name where no rule declares it; or registered:,
    the one loaded family left, for files without a name."""
    captured = captured_fonts(fonts)
    ruled = rule_files(face_rules, captured, statuses)
    ruled = ruled.select("page_id", F.concat(F.lit("css:"), F.lower(font_names.clean_family(F.col("family")))).alias("grp"), F.col("family").alias("css"), "url", "format", "binary", "covers_latin", "loaded", "captured", "face", F.col("rule").alias("seq"))
    free = captured.join(face_rules.select("page_id", "url").distinct(), ["page_id", "url"], "left_anti")
    families = registered(statuses, face_rules)
    named = free.filter("binary is not null")
    owned = claims(named.select("page_id", "binary").distinct(), families)
    alias = owned.groupBy("page_id", "binary").agg(F.min("family").alias("css"))
    face = lambda css: font_names.face_key(css, F.col("weight"), F.col("style"), F.lit(None).cast("string"))
    rest = lambda df, grp: df.select("page_id", grp.alias("grp"), "css", "url", "format", "binary", F.coalesce("covers_latin", F.lit(True)).alias("covers_latin"), F.lit(True).alias("loaded"), F.lit(True).alias("captured"), face(F.lit("")).alias("face"), (F.col("seq") + F.lit(1 << 40)).alias("seq"))
    by_name = rest(named.join(alias, ["page_id", "binary"], "left"), F.concat(F.lit("bin:"), F.lower("binary")))
    left = families.join(owned.select("page_id", "family"), ["page_id", "family"], "left_anti").groupBy("page_id").agg(F.count(F.lit(1)).alias("n"), F.min("family").alias("css")).filter("n = 1").drop("n")
    nameless = rest(free.filter("binary is null").join(left, "page_id"), F.concat(F.lit("registered:"), F.lower("css")))
    return ruled.unionByName(by_name).unionByName(nameless)


def named_groups(files: DataFrame) -> DataFrame:
    """``files`` with family, the name that its group is shown by: of its loaded, parsed, Latin file, else of the next best."""
    parsed = F.col("binary").isNotNull()
    rank = F.when(F.col("loaded") & parsed & F.col("covers_latin"), 0).when(parsed & F.col("covers_latin"), 1).when(parsed, 2).otherwise(3)
    said = files.groupBy("page_id", "grp").agg(F.min_by(F.struct("binary", "css"), F.struct(rank, "seq")).alias("x"), F.min_by("css", F.when(F.col("css").isNotNull(), F.col("seq"))).alias("first_css"))
    said = said.withColumn("family", font_names.shown_family(F.col("x.binary"), F.coalesce("x.css", "first_css"))["name"])
    return files.join(said.select("page_id", "grp", "family"), ["page_id", "grp"])


def usage_shares(usage: DataFrame, files: DataFrame, statuses: DataFrame) -> DataFrame:
    """page_id, key (family in lower case), chars and usage: text goes to the first family of its stack with a loaded face."""
    lower = lambda c: F.lower(F.col(c))
    loaded = files.filter("captured and css is not null").select("page_id", lower("css").alias("name"))
    loaded = loaded.union(files.filter("css is null or not grp like 'css:%'").select("page_id", lower("binary"))).union(statuses.filter("status = 'loaded'").select("page_id", lower("family"))).filter("name is not null").distinct()
    called = files.filter("css is not null").select("page_id", lower("css").alias("name"), lower("family").alias("key"), F.lit(0).alias("pref"), "seq")
    called = called.union(files.filter("not grp like 'css:%'").select("page_id", lower("family"), lower("family"), F.lit(1), "seq"))
    called = called.groupBy("page_id", "name").agg(F.min_by("key", F.struct("pref", "seq")).alias("key"))
    text = usage.withColumn("total", F.sum("chars").over(Window.partitionBy("page_id")))
    tried = text.select("page_id", "stack", "chars", "total", F.posexplode(font_names.stack_names(F.col("stack"))).alias("pos", "name")).withColumn("name", F.lower("name")).join(loaded, ["page_id", "name"], "left_semi")
    first = tried.groupBy("page_id", "stack", "chars", "total").agg(F.min_by("name", "pos").alias("name"))
    counted = first.join(called, ["page_id", "name"]).groupBy("page_id", "key").agg(F.sum("chars").alias("chars"), F.max("total").alias("total"))
    return counted.select("page_id", "key", "chars", (F.floor(F.col("chars") / F.col("total") * 10_000 + 0.5) / 10_000).alias("usage"))


def build_families(face_rules: DataFrame, fonts: DataFrame, statuses: DataFrame, usage: DataFrame, pages: DataFrame) -> DataFrame:
    """page_id, id, name, css_families, source, usage, used_on_page, faces and files of each font family.

    ``usage`` has one row for each (page_id, stack).  A family with one file of a service that does not let its files be had takes that source."""
    files = named_groups(grouped_files(face_rules, fonts, statuses)).join(pages.select("page_id", "host"), "page_id", "left")
    files = files.withColumn("key", F.lower("family")).withColumn("source", font_names.file_source(rules.url_host(F.col("url")), F.col("host")))
    parsed = F.col("binary").isNotNull()
    rank = F.when(F.col("loaded") & parsed & F.col("covers_latin"), 0).when(parsed & F.col("covers_latin"), 1).when(parsed, 2).otherwise(3)
    out = files.groupBy("page_id", "key").agg(
        F.min_by("family", "seq").alias("name"), F.array_join(F.array_sort(F.collect_set("css")), ",").alias("css_families"), F.max(F.col("source") == "adobe-fonts").alias("adobe"), F.min_by("source", F.struct(rank, "seq")).alias("own"),
        F.max("loaded").alias("loaded"), F.count_distinct("face").alias("faces"), F.count_distinct("url").alias("files"),
    )
    out = out.join(usage_shares(usage, files, statuses), ["page_id", "key"], "left").withColumn("usage", F.coalesce("usage", F.lit(0.0)))
    base = F.regexp_replace(F.regexp_replace("key", "[^a-z0-9]+", "-"), "^-|-$", "")
    out = out.withColumn("used_on_page", F.col("loaded") | (F.coalesce("chars", F.lit(0)) > 0)).withColumn("base", F.concat(F.lit("font-"), F.coalesce(F.nullif(base, F.lit("")), F.lit("family"))))
    again = F.row_number().over(Window.partitionBy("page_id", "base").orderBy(F.desc("usage"), F.desc("used_on_page"), "key"))
    return out.select("page_id", F.when(again > 1, F.concat("base", F.lit("-"), again.cast("string"))).otherwise(F.col("base")).alias("id"), "name", "css_families", F.when(F.col("adobe"), "adobe-fonts").otherwise(F.col("own")).alias("source"), "usage", "used_on_page", "faces", "files")


def signing_order(files: DataFrame) -> DataFrame:
    """``files`` with place: loaded faces' files first, then Latin ones of other faces, then the rest; in each, as they come."""
    tier = F.when(F.col("loaded"), 0).otherwise(2) + F.when(F.col("covers_latin"), 0).otherwise(1)
    return files.withColumn("place", F.row_number().over(Window.partitionBy("page_id").orderBy(tier, "seq")).cast("long"))


def _single_weight(weight: Column) -> Column:
    w = F.lower(F.trim(weight))
    return F.when(w.rlike(r"\s"), None).when(w == "normal", 400.0).when(w == "bold", 700.0).otherwise(w.try_cast("double"))


def candidates(files: DataFrame) -> DataFrame:
    """page_id, family, reason (why nothing can be installed, or null) and url of the best file: loaded, variable, upright, nearest to regular, needing no conversion.

    ``files`` has page_id, family, source, url, format, weight, style, loaded, covers_latin and seq."""
    latin, fit, there = F.col("covers_latin"), F.col("format").isin(*INSTALLABLE), F.coalesce(F.col("url"), F.lit("")) != ""
    weight = _single_weight(F.col("weight"))
    rank = F.struct((~F.col("loaded")).cast("int"), weight.isNotNull().cast("int"), F.col("style").rlike("(?i)italic|oblique").cast("int"), F.abs(F.coalesce(weight, F.lit(400.0)) - 400), (~F.col("format").isin(*NATIVE)).cast("int"), "seq")
    any_ = lambda c: F.max(F.coalesce(c, F.lit(False)))
    out = files.groupBy("page_id", "family").agg(any_(F.col("source") == "adobe-fonts").alias("adobe"), any_(latin).alias("a"), any_(latin & fit).alias("b"), any_(latin & fit & there).alias("c"), F.min_by("url", F.when(latin & fit & there, rank)).alias("best"))
    reason = F.when(F.col("adobe"), "adobe-fonts").when(~F.col("a"), "no-latin-file").when(~F.col("b"), "unsupported-format").when(~F.col("c"), "not-downloadable")
    return out.select("page_id", "family", reason.alias("reason"), F.when(reason.isNull(), F.col("best")).alias("url"))


def specimen(files: DataFrame) -> DataFrame:
    """page_id, family and url of the file that is likeliest to show Latin text: a weighted sum of loaded, upright, Latin, distance from regular and format."""
    low, high = (F.element_at(F.split(F.trim("weight"), r"\s+"), i).try_cast("double") for i in (1, -1))
    away = F.when(low.isNull(), 500.0).when((low <= 400) & (high >= 400), 0.0).otherwise(F.least(F.abs(400 - low), F.abs(400 - high)))
    form = F.when(F.col("format") == "woff2", 0).when(F.col("format") == "woff", 1).when(F.col("format") == "ttf", 2).when(F.col("format") == "otf", 3).otherwise(9)
    rank = F.when(F.col("loaded"), 0).otherwise(10_000) + F.when(F.trim("style") == "normal", 0).otherwise(5_000) + F.when(F.col("covers_latin"), 0).otherwise(2_000) + away * 2 + form
    return files.filter("format <> 'eot'").groupBy("page_id", "family").agg(F.min_by("url", F.struct(rank, "seq")).alias("url"))
