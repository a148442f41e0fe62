"""Registered queries over the derived relations, each with SQL of its own."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import color, parsers, rules
from ..operators import assets, palette, selection
from ..sources import ndjson
from ..streaming import admission
from . import relations as r
from .relations import oracle_relation as o
from .relations import spark_relation

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(relation: str | None, sql: str | None = None):
    """Register a function of a derived relation (or of spark and sf_dir) under its name."""

    def register(f):
        QUERIES[f.__name__] = (lambda spark, sf_dir: f(spark_relation(spark, sf_dir, relation))) if relation else f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


_SMALL = "(role NOT IN ('site-logo', 'logo', 'favicon', 'social') AND CASE WHEN greatest(rendered_w, rendered_h) > 0 THEN greatest(rendered_w, rendered_h) ELSE greatest(width, height) END BETWEEN 0.5 AND 48)"
_SECTION = f"CASE WHEN role IN ('site-logo', 'logo', 'favicon') THEN 'logos' WHEN declared_only THEN 'stylesheets' WHEN {_SMALL} THEN 'small-icons' WHEN kind = 'svg' THEN 'svg' ELSE 'images' END"
_PLACE = "CASE section WHEN 'logos' THEN 0 WHEN 'svg' THEN 1 WHEN 'images' THEN 2 WHEN 'small-icons' THEN 3 ELSE 4 END"
_SECTIONS = f"(SELECT *, row_number() OVER (PARTITION BY page_id, section ORDER BY (section = 'images' AND role <> 'social'), score DESC, ord, id) AS rank FROM (SELECT *, ({_PLACE})::BIGINT AS place FROM (SELECT *, {_SECTION} AS section FROM {o(r.ASSETS)})))"


@query(r.ASSETS, f"SELECT page_id, section, place, rank, id FROM {_SECTIONS}")
def q1_sectionize(df):
    return assets.sectionize(df).select("page_id", "section", "place", "rank", "id")


@query(r.ASSETS, f"SELECT section, kind, count(*) AS n, sum(bytes)::BIGINT AS bytes, max(score) AS top_score FROM {_SECTIONS} GROUP BY section, kind")
def q1_section_totals(df):
    return assets.sectionize(df).groupBy("section", "kind").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"), F.max("score").alias("top_score"))


@query(r.ASSETS, f"SELECT page_id, id, row_number() OVER (PARTITION BY page_id ORDER BY place, rank) AS item FROM {_SECTIONS} WHERE section NOT IN ('small-icons', 'stylesheets')")
def q2_visible_items(df):
    return assets.visible_items(assets.sectionize(df)).select("page_id", "id", "item")


@query(r.ASSETS, f"SELECT page_id, id FROM (SELECT *, {_SMALL} AS small FROM {o(r.ASSETS)}) WHERE declared_only OR NOT small")
def q4_download_scope(df):
    return df.filter(F.col("declared_only") | ~rules.small_icon(*map(F.col, ("role", "rendered_w", "rendered_h", "width", "height")))).select("page_id", "id")


@query(r.ASSETS, f"SELECT page_id, id, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, ord, id) AS rank, row_number() OVER (PARTITION BY page_id, kind ORDER BY ord, id) AS kind_index FROM {o(r.ASSETS)}")
def w1_w2_ranks(df):
    return assets.ranked(df).select("page_id", "id", "rank", "kind_index")


@query(r.ASSETS, f"SELECT page_id, id, name FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY width * height DESC, score DESC, ord, id) AS n FROM {o(r.ASSETS)} WHERE contains(lower(name), 'hero_1') OR contains(lower(filename), 'hero_1') OR contains(lower(url), 'hero_1')) WHERE n <= 20")
def f2_search_largest(df):
    from pyspark.sql import Window

    return assets.searched(df, "Hero_1").withColumn("n", F.row_number().over(Window.partitionBy("page_id").orderBy(*assets.sort_keys("largest")))).filter("n <= 20").select("page_id", "id", "name")


@query(r.ASSETS, f"SELECT page_id, count(*) AS assets, count(*) FILTER (kind = 'svg') AS svg, count(*) FILTER (kind = 'image') AS images, sum(bytes)::BIGINT AS bytes FROM {o(r.ASSETS)} GROUP BY page_id")
def a4_a5_counts(df):
    return df.groupBy("page_id").agg(F.count(F.lit(1)).alias("assets"), F.count_if(F.col("kind") == "svg").alias("svg"), F.count_if(F.col("kind") == "image").alias("images"), F.sum("bytes").alias("bytes"))


@query(r.ASSETS, rf"SELECT id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(name)), '\.[a-z0-9]{{2,5}}$', ''), '([@._-]([0-9]+x|[0-9]{{2,5}}x[0-9]{{2,5}}|large|larger|small|smaller|medium|thumb|thumbnail|scaled|resized|full|original|orig|min|hd|retina|mobile|tablet|desktop))+$', ''), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM {o(r.ASSETS)}")
def p28_normalized_name(df):
    return df.select("id", rules.normalized_name(F.col("name")).alias("slug"))


_BYTES = "CASE WHEN b < 999.5 THEN floor(b + 0.5)::BIGINT || ' B' " + " ".join(f"WHEN b / {1024**i}.0 < {999.5 if i < 4 else 1e18} THEN CASE WHEN b / {1024**i}.0 < 9.95 THEN printf('%.1f', b / {1024**i}.0) ELSE (floor(b / {1024**i}.0 + 0.5)::BIGINT)::VARCHAR END || ' {u}'" for i, u in enumerate(("KB", "MB", "GB", "TB"), 1)) + " END"


@query(r.ASSETS, f"SELECT id, {_BYTES} AS size FROM (SELECT id, bytes::DOUBLE AS b FROM {o(r.ASSETS)} WHERE bytes IS NOT NULL)")
def p47_format_bytes(df):
    return df.filter("bytes is not null").select("id", rules.format_bytes(F.col("bytes").cast("double")).alias("size"))


_HOST = r"lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#@]*@)?([^/?#:]*)', 2))"
_PATH = r"regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"


def _case(key: str, table: dict[str, str], default: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + f" ELSE {default} END"


_URL_FORMAT = f"CASE WHEN url LIKE 'data:%' THEN {_case("split_part(split_part(substr(url, 6), ';', 1), ',', 1)", rules.MIME_FORMATS, "'other'")} ELSE {_case(f"lower(regexp_extract({_PATH}, '[.]([A-Za-z0-9]+)$', 1))", rules.EXTENSION_FORMATS, "'other'")} END"


@query(r.URLS, f"SELECT id, {_URL_FORMAT} AS from_url, {_case("lower(split_part(coalesce(content_type, ''), ';', 1))", rules.MIME_FORMATS, _URL_FORMAT)} AS format FROM {o(r.URLS)}")
def p14_formats(df):
    return df.select("id", rules.format_from_url(F.col("url")).alias("from_url"), rules.format_of(F.col("content_type"), F.col("url")).alias("format"))


@query(r.URLS, f"SELECT id, h AS host, CASE WHEN len(p) > 2 AND len(p[-1]) = 2 AND p[-2] IN ('co', 'com', 'org', 'net', 'gov', 'edu', 'ac') THEN p[-3] WHEN len(p) > 1 THEN p[-2] ELSE p[-1] END AS label FROM (SELECT id, h, string_split(h, '.') AS p FROM (SELECT id, regexp_replace({_HOST}, '^www[.]', '') AS h FROM {o(r.URLS)}))")
def p2_site_labels(df):
    return df.select("id", rules.display_host(F.col("url")).alias("host"), rules.site_label(F.col("url")).alias("label"))


def _listed(entries: list[str]) -> str:
    return "(" + " OR ".join(f"((h = '{e.split('/')[0]}' OR h LIKE '%.{e.split('/')[0]}')" + (f" AND lower(p) LIKE '/{e.split('/', 1)[1]}%'" if "/" in e else "") + ")" for e in entries) + ")"


# The relation's hosts that are listed, written out here: the query's lists are not asked.
_NOISE = f"""SELECT id, page_id, CASE WHEN url LIKE 'data:image/svg%' THEN CASE WHEN svg_text LIKE '%<g/>%' OR svg_text LIKE '%feGaussianBlur%' THEN 'placeholder' END
  WHEN url LIKE 'data:%' THEN CASE WHEN greatest(width, height) < 64 OR length(url) * 0.75 < 1024 THEN 'tiny-data-uri' END WHEN url LIKE 'blob:%' THEN 'blob-unavailable' WHEN NOT regexp_matches(lower(url), '^https?://') THEN 'not-image'
  WHEN {_listed(["google-analytics.com", "pinimg.com/ct"])} OR (regexp_matches(p, '/(tr|collect|pixel|beacon|track|impression|__imp|b/ss|g/collect|j/collect)(/|[?]|$)') AND width <= 2) THEN 'tracker'
  WHEN regexp_matches(p, '/(pixel|spacer|blank|transparent|clear|1x1|trans|empty)[.](gif|png)$') THEN 'spacer' WHEN width <= 2 AND height <= 2 THEN 'pixel'
  WHEN content_type IS NOT NULL AND content_type NOT ILIKE 'image/%' AND content_type NOT ILIKE '%octet-stream%' AND content_type NOT ILIKE '%binary%' THEN 'not-image' WHEN {_listed(["cookielaw.org"])} THEN 'consent' WHEN {_listed(["intercomcdn.com"])} THEN 'widget' END AS reason
FROM (SELECT *, {_HOST} AS h, {_PATH} AS p FROM {o(r.URLS)})"""


def _noise() -> F.Column:
    none = F.lit(None)
    return rules.noise_reason(F.col("url"), F.col("content_type"), F.col("width"), F.col("height"), none.cast("double"), F.col("svg_text"), none.cast("boolean"))


@query(r.URLS, f"SELECT id, reason FROM ({_NOISE})")
def p20_noise_reason(df):
    return df.select("id", _noise().alias("reason"))


@query(r.URLS, f"SELECT page_id, coalesce(reason, 'kept') AS reason, count(*) AS n FROM ({_NOISE}) GROUP BY ALL")
def f1_a3_hidden_reasons(df):
    return assets.counted_noise(df, _noise())


_SCORED = f"""SELECT *, 3 * lw::BIGINT + 3 * (n % 5 = 0)::BIGINT + 2 * (n % 3 = 0 OR n % 7 = 0)::BIGINT + 2 * (n % 11 = 0)::BIGINT + (visible AND ord % 400 < 160)::BIGINT + (n % 13 = 0)::BIGINT AS logo
  FROM (SELECT *, ord AS n, ord % 6 = 0 AS lw, ord % 10 = 9 AS wall FROM {o(r.ASSETS)})"""
_FOUND = "CASE n % 9 WHEN 0 THEN 'json-ld' WHEN 1 THEN 'icon-link' WHEN 2 THEN 'og-image' WHEN 3 THEN 'video-poster' ELSE 'img-src' END"
_ROLE = f"""SELECT id, logo, w, CASE WHEN f = 'json-ld' OR logo >= 6 AND shaped THEN 'site-logo' WHEN f = 'icon-link' THEN 'favicon' WHEN f = 'og-image' THEN 'social' WHEN (lw OR wall OR name ILIKE '%logo%') AND shaped THEN 'logo'
  WHEN n % 29 = 0 THEN 'sprite-symbol' WHEN side > 0 AND side <= 48 THEN 'icon' WHEN kind = 'svg' THEN 'illustration' ELSE 'image' END AS role, rendered_w, rendered_h, visible, ord FROM (
  SELECT *, width AS w, area <= 120000 AND NOT coalesce(short > 0 AND long > 30 * short, false) AND f <> 'video-poster' AS shaped FROM (
  SELECT *, {_FOUND} AS f, rendered_w > 0 AND rendered_h > 0 AS drawn, CASE WHEN rendered_w > 0 AND rendered_h > 0 THEN rendered_w * rendered_h WHEN kind = 'svg' OR wall OR logo >= 6 THEN 0 ELSE width * height END AS area,
  CASE WHEN rendered_w > 0 AND rendered_h > 0 THEN greatest(rendered_w, rendered_h) ELSE greatest(width, height) END AS long, CASE WHEN rendered_w > 0 AND rendered_h > 0 THEN least(rendered_w, rendered_h) ELSE least(width, height) END AS short,
  CASE WHEN greatest(rendered_w, rendered_h) > 0 THEN greatest(rendered_w, rendered_h) ELSE greatest(width, height) END AS side FROM ({_SCORED})))"""


def _roles(df):
    n, no = F.col("ord"), F.lit(False)
    df = df.withColumn("logo", rules.logo_score(n % 6 == 0, n % 5 == 0, n % 3 == 0, n % 7 == 0, n % 11 == 0, F.col("visible"), n % 400, n % 13 == 0))
    found = F.array(F.when(n % 9 == 0, "json-ld").when(n % 9 == 1, "icon-link").when(n % 9 == 2, "og-image").when(n % 9 == 3, "video-poster").otherwise("img-src"))
    return df.withColumn("role", rules.role(F.col("kind"), F.col("format"), found, F.col("logo"), n % 6 == 0, n % 10 == 9, F.col("name"), n % 29 == 0, F.col("width"), F.col("height"), F.col("rendered_w"), F.col("rendered_h"), no, no))


@query(r.ASSETS, f"SELECT id, logo, role FROM ({_ROLE})")
def p22_p23_roles(df):
    return _roles(df).select("id", "logo", "role")


@query(r.ASSETS, f"SELECT id, round({"CASE role " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in rules.ROLE_WEIGHTS.items()) + " END"} + CASE WHEN visible THEN least(rendered_w * rendered_h / 1000, 90) + 50 ELSE 0 END - 0.01 * ord, 6)::DOUBLE AS score FROM ({_ROLE})")
def p24_relevance(df):
    return _roles(df).select("id", F.round(rules.relevance(F.col("role"), F.col("rendered_w"), F.col("rendered_h"), F.col("visible"), F.col("ord")), 6).alias("score"))


@query(r.ASSETS, f"SELECT id, CASE WHEN width * height > 0 AND ord % 2 = 0 THEN width * height WHEN rendered_w > 0 AND ord % 3 = 0 THEN rendered_w * rendered_w * 0.6::DOUBLE WHEN bytes > 0 THEN bytes / 1000000.0::DOUBLE ELSE 0 END::DOUBLE AS size_score FROM {o(r.ASSETS)}")
def p26_size_score(df):
    none = F.lit(None).cast("double")
    return df.select("id", rules.size_score(none, F.when(F.col("ord") % 2 == 0, F.col("width") * F.col("height")), none, F.when(F.col("ord") % 3 == 0, F.col("rendered_w")), none, F.col("bytes")).alias("size_score"))


_MERGED = f"""SELECT page_id, url, (SELECT string_agg(found_in, ',' ORDER BY m) FROM (SELECT found_in, min(ord) AS m FROM c x WHERE x.page_id = c.page_id AND x.url = c.url GROUP BY found_in)) AS found_in,
  min(ord) AS ord, bool_or(visible) AS visible, bool_and(declared_only) AS declared_only, max(descriptor_w) AS descriptor_w,
  arg_max(natural_w, (natural_w * natural_h, -ord)) AS natural_w, arg_max(natural_h, (natural_w * natural_h, -ord)) AS natural_h,
  arg_min(label, ord) FILTER (label IS NOT NULL) AS label, max(logo_score)::INTEGER AS logo_score, count(DISTINCT grp) AS used_count FROM c GROUP BY page_id, url"""


@query(r.CANDIDATES, f"WITH c AS {o(r.CANDIDATES)} {_MERGED}")
def a1_merge_candidates(df):
    return assets.merge_candidates(df)


@query(None, f"""WITH c AS {o(r.CANDIDATES)}, m AS (SELECT page_id, url, min(ord) AS ord FROM c GROUP BY ALL), k AS {o(r.CAPTURES)}
  SELECT m.page_id, m.url, m.ord, k.status, k.bytes, 'candidate' AS source FROM m LEFT JOIN k USING (page_id, url)
  UNION ALL SELECT page_id, url, NULL, status, bytes, 'network' FROM k ANTI JOIN m USING (page_id, url) WHERE status BETWEEN 200 AND 399""")
def j1_j3_captures(spark, sf_dir):
    merged = assets.merge_candidates(spark_relation(spark, sf_dir, r.CANDIDATES)).select("page_id", "url", "ord")
    return assets.with_captures(merged, spark_relation(spark, sf_dir, r.CAPTURES))


@query(None, "SELECT page_id, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) || '/favicon.ico' AS url FROM pages WHERE page_id % 3 <> 0")
def s10_implicit_favicons(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return assets.implicit_favicons(pages, pages.filter("page_id % 3 = 0").select("page_id"))


_COMPONENTS = f"""WITH RECURSIVE m AS {o(r.MEMBERS)}, g AS (SELECT *, CASE WHEN art_directed THEN NULL WHEN grp1 IS NOT NULL AND grp2 IS NOT NULL THEN coalesce(preferred_group, grp1) ELSE coalesce(grp1, grp2) END AS grp FROM m),
  k AS (SELECT page_id, idx, 'g' || grp AS key FROM g WHERE grp IS NOT NULL UNION ALL SELECT page_id, idx, 'v' || variant_key FROM m UNION ALL SELECT page_id, idx, 's' || sha1 FROM m WHERE sha1 IS NOT NULL),
  f AS (SELECT page_id, key, min(idx) AS low FROM k GROUP BY ALL), e AS (SELECT DISTINCT page_id, idx AS a, low AS b FROM k JOIN f USING (page_id, key)), b AS (SELECT page_id, a, b FROM e UNION SELECT page_id, b, a FROM e),
  t AS (SELECT page_id, a, b FROM b UNION SELECT t.page_id, t.a, b.b FROM t JOIN b ON t.page_id = b.page_id AND t.b = b.a), c AS (SELECT page_id, a AS idx, min(b) AS root FROM t GROUP BY ALL)"""


def _members(df):
    return df.withColumn("groups", F.array_compact(F.array("grp1", "grp2")))


@query(r.MEMBERS, _COMPONENTS + " SELECT page_id, idx, root, kind AS group_kind FROM c JOIN m USING (page_id, idx)")
def d1_variant_groups(df):
    return assets.variant_groups(_members(df))


@query(r.MEMBERS, _COMPONENTS + " SELECT page_id, root, kind AS group_kind, arg_max(idx, (size_score, -idx)) AS best, count(*) AS members FROM c JOIN m USING (page_id, idx) GROUP BY ALL")
def d2_best_members(df):
    return assets.best_members(df, assets.variant_groups(_members(df)))


_LAB = """SELECT *, 0.2104542553 * l1 + 0.793617785 * m1 - 0.0040720468 * s1 AS l, 1.9779984951 * l1 - 2.428592205 * m1 + 0.4505937099 * s1 AS a, 0.0259040371 * l1 + 0.7827717662 * m1 - 0.808675766 * s1 AS b, 0.2126 * r + 0.7152 * g + 0.0722 * bl AS y FROM (
  SELECT *, cbrt(0.4122214708 * r + 0.5363325363 * g + 0.0514459929 * bl) AS l1, cbrt(0.2119034982 * r + 0.6806995451 * g + 0.1073969566 * bl) AS m1, cbrt(0.0883024619 * r + 0.2817188376 * g + 0.6299787005 * bl) AS s1 FROM (
  SELECT hex, page_id, """ + ", ".join(f"CASE WHEN c{i} / 255.0::DOUBLE <= 0.04045 THEN c{i} / 255.0::DOUBLE / 12.92 ELSE pow((c{i} / 255.0::DOUBLE + 0.055) / 1.055, 2.4) END AS {n}" for i, n in enumerate(("r", "g", "bl"))) + " FROM (SELECT DISTINCT hex, page_id, " + ", ".join(f"('0x' || substr(hex, {2 + 2 * i}, 2))::INTEGER AS c{i}" for i in range(3)) + f" FROM {o(r.COLORS)})))"


@query(r.COLORS, f"SELECT hex, page_id, round(l, 6) AS l, round(sqrt(a * a + b * b), 6) AS c, round(CASE WHEN y > 0.008856 THEN 116 * cbrt(y) - 16 ELSE 903.3 * y END, 6) AS lstar, round((greatest(y, 1) + 0.05) / (least(y, 1) + 0.05), 6) AS on_white, sqrt(a * a + b * b) < CASE WHEN l < 0.3 THEN 0.075 WHEN l > 0.92 THEN 0.04 ELSE 0.048 END AS neutral FROM ({_LAB})")
def p30_colors(df):
    l_, c, _ = color.oklch(F.col("hex"))
    return df.select("hex", "page_id").distinct().select("hex", "page_id", F.round(l_, 6).alias("l"), F.round(c, 6).alias("c"), F.round(color.lstar(F.col("hex")), 6).alias("lstar"), F.round(color.contrast(F.col("hex"), F.lit("#ffffff")), 6).alias("on_white"), color.is_neutral(l_, c).alias("neutral"))


@query(r.COLORS, f"SELECT page_id, source, hex, weight, n, round(weight / sum(weight) OVER (PARTITION BY page_id, source), 9) AS share FROM (SELECT page_id, source, hex, sum(weight) AS weight, sum(n)::BIGINT AS n FROM {o(r.COLORS)} GROUP BY ALL)")
def a8_a9_shares(df):
    return palette.shares(df).withColumn("share", F.round("share", 9))


@query(r.COLORS, f"SELECT page_id, bin, n, round(n / sum(n) OVER (PARTITION BY page_id), 9)::DOUBLE AS share FROM (SELECT page_id, ((('0x' || substr(hex, 2, 2))::BIGINT >> 3) << 10) + ((('0x' || substr(hex, 4, 2))::BIGINT >> 3) << 5) + (('0x' || substr(hex, 6, 2))::BIGINT >> 3) AS bin, sum(n)::BIGINT AS n FROM {o(r.COLORS)} GROUP BY ALL)")
def a10_histogram(df):
    return palette.histogram(df).withColumn("share", F.round("share", 9))


@query(r.COLORS)
def d7_color_clusters(df):
    return palette.clusters(palette.salience(df))


@query(r.REQUESTS, f"""WITH q AS (SELECT *, ts::DATE AS day, date_trunc('month', ts) AS month FROM {o(r.REQUESTS)}), a AS (SELECT *, row_number() OVER (PARTITION BY day, client ORDER BY ts, request_id) AS c FROM q),
  b AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY ts, request_id) AS d FROM a WHERE c <= 20), m AS (SELECT *, row_number() OVER (PARTITION BY month ORDER BY ts, request_id) AS n FROM b WHERE d <= 80)
  SELECT a.request_id, CASE WHEN a.c > 20 THEN 'client' WHEN b.d > 80 THEN 'day' WHEN m.n > 800 THEN 'month' ELSE 'admitted' END AS verdict FROM a LEFT JOIN b USING (request_id) LEFT JOIN m USING (request_id)""")
def t5_admission(df):
    return admission.admitted(df)


@query(r.REQUESTS, f"SELECT epoch(time_bucket(INTERVAL '10 minutes', ts))::BIGINT AS start, client, count(*) AS n FROM {o(r.REQUESTS)} GROUP BY ALL")
def t11_windows(df):
    return admission.counted_windows(df.withColumn("ts", F.col("ts").cast("timestamp"))).withColumn("start", F.unix_timestamp("start"))


@query(r.REQUESTS, f"SELECT epoch(date_trunc('day', ts))::BIGINT AS start, sum(CASE WHEN type = 'error' THEN -1 ELSE 1 END)::BIGINT AS net FROM {o(r.REQUESTS)} GROUP BY ALL")
def t6_refunds(df):
    return admission.refunded(df.withColumn("delta", F.when(F.col("type") == "error", -1).otherwise(1).cast("long"))).withColumn("start", F.unix_timestamp(F.col("start").cast("timestamp")))


@query(r.REQUESTS, f"SELECT client AS scan_id, arg_max(bytes, request_id) FILTER (type = 'view') AS page, count(*) AS n_events, bool_or(type IN ('done', 'error')) AS ended FROM {o(r.REQUESTS)} GROUP BY client")
def t4_latest_events(df):
    events = df.select(F.col("client").alias("scan_id"), F.col("request_id").alias("seq"), F.when(F.col("type") == "view", "page").otherwise(F.col("type")).alias("type"), F.col("bytes").alias("payload"))
    return admission.latest_events(events)


@query(r.REQUESTS, f"SELECT client, host, place FROM (SELECT *, row_number() OVER (PARTITION BY client ORDER BY last DESC) AS place FROM (SELECT client, bytes % 9 AS host, max((ts, request_id)) AS last FROM {o(r.REQUESTS)} GROUP BY ALL)) WHERE place <= 5")
def q8_recent_hosts(df):
    return admission.recent_hosts(df.withColumn("host", F.col("bytes") % 9))


_PREF = "kind <> 'svg', width * height DESC, CASE format WHEN 'svg' THEN 0 WHEN 'png' THEN 1 WHEN 'webp' THEN 2 WHEN 'avif' THEN 3 WHEN 'jpg' THEN 4 WHEN 'gif' THEN 5 ELSE 6 END, score DESC, ord, id"
_SLUG = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim({})), '\.[a-z0-9]{{2,5}}$', ''), '([@._-]([0-9]+x|[0-9]{{2,5}}x[0-9]{{2,5}}|large|larger|small|smaller|medium|thumb|thumbnail|scaled|resized|full|original|orig|min|hd|retina|mobile|tablet|desktop))+$', ''), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"


def _selection_sql(deck: bool, most: int, budget: int, gate: int | None, ceiling: int, wanted: str = "true", icons: bool = False, sprites: bool = False, ids: str | None = None) -> str:
    """Rows with drop_reason, by literal rules; a budget or ceiling of 0 is none."""
    kinds = f"role NOT IN ('sprite-symbol'{"" if icons else ", 'icon'"})" if not sprites else "true" if icons else "role <> 'icon'"
    small = "true" if gate is None else f"kind = 'svg' OR role IN ('site-logo', 'logo', 'favicon'{", 'icon'" if icons else ""}) OR greatest(width, height) >= {gate}"
    steps = [("unavailable", "SELECT * FROM {} WHERE url IS NOT NULL"), ("filter", f"SELECT * FROM {{}} WHERE {ids or wanted}")]
    if deck and not ids:
        steps += [("profile", f"SELECT * FROM {{}} WHERE {kinds}"), ("extra-favicon", f"SELECT * FROM {{}} QUALIFY role <> 'favicon' OR row_number() OVER (PARTITION BY page_id, role = 'favicon' ORDER BY {_PREF}) = 1")]
    if not ids:
        steps += [("small", f"SELECT * FROM {{}} WHERE {small}"), ("too-large", f"SELECT * FROM {{}} WHERE {f'coalesce(bytes, 0) <= {ceiling}' if ceiling else 'true'}")]
    if deck and not ids:
        steps += [("vector-preferred", "SELECT * FROM {} QUALIFY kind = 'svg' OR slug = '' OR NOT bool_or(kind = 'svg') OVER (PARTITION BY page_id, slug)")]
    if not ids:
        steps += [("duplicate", f"SELECT * FROM {{}} QUALIFY row_number() OVER (PARTITION BY page_id, sha1 ORDER BY {_PREF}) = 1")]
    parts, before = [f"s0 AS (SELECT *, {_SLUG.format("filename")} AS slug FROM {o(r.ASSETS)})"], "s0"
    for i, (_, sql) in enumerate(steps, 1):
        parts.append(f"s{i} AS ({sql.format(before)})")
        before = f"s{i}"
    parts += [
        f"p AS (SELECT *, count(*) OVER (PARTITION BY page_id) AS pool, floor({most} * count(*) OVER (PARTITION BY page_id, kind) / (count(*) OVER (PARTITION BY page_id))::DOUBLE) AS quota, row_number() OVER (PARTITION BY page_id, kind ORDER BY score DESC, ord, id) AS k FROM {before})",
        f"q AS (SELECT *, pool <= {most} OR k <= quota AS first FROM p)", f"u AS (SELECT *, {most} - sum(first::INT) OVER (PARTITION BY page_id) AS room, row_number() OVER (PARTITION BY page_id, first ORDER BY score DESC, ord, id) AS rest FROM q)",
        "capped AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, ord, id) AS n FROM u WHERE first OR rest <= room)",
        f"g AS (SELECT page_id, n, id, coalesce(bytes, 0) <= {budget or 10**15} AS fits, CASE WHEN coalesce(bytes, 0) <= {budget or 10**15} THEN coalesce(bytes, 0) ELSE 0 END::BIGINT AS spent FROM capped WHERE n = 1 UNION ALL SELECT s.page_id, s.n, s.id, g.spent + coalesce(bytes, 0) <= {budget or 10**15}, (g.spent + CASE WHEN g.spent + coalesce(bytes, 0) <= {budget or 10**15} THEN coalesce(bytes, 0) ELSE 0 END)::BIGINT FROM g JOIN capped s ON s.page_id = g.page_id AND s.n = g.n + 1)",
    ]
    names = [reason if reason != "profile" else "CASE WHEN s0.role = 'icon' THEN 'icon' ELSE 'sprite' END" for reason, _ in steps]
    reasons = "CASE " + " ".join(f"WHEN s{i}.id IS NULL THEN {n if n.startswith('CASE') else repr(n)}" for i, n in enumerate(names, 1)) + " WHEN capped.id IS NULL THEN 'cap' WHEN NOT g.fits THEN 'over-budget' END"
    joined = " ".join(f"LEFT JOIN {t} ON {t}.id = s0.id" for t in [*(f"s{i}" for i in range(1, len(steps) + 1)), "capped", "g"])
    return f"WITH RECURSIVE {', '.join(parts)} SELECT s0.*, {reasons} AS drop_reason FROM s0 {joined}"


_DEFAULT = _selection_sql(True, 20, 10_000_000, 600, 8388608)
_OPTIONS = selection.Options(most=20, most_bytes=10_000_000)


@query(r.ASSETS, f"SELECT page_id, id, drop_reason FROM ({_DEFAULT})")
def e4_select_assets(df):
    return selection.select_assets(df, _OPTIONS).select("page_id", "id", "drop_reason")


@query(r.ASSETS, f"SELECT page_id, id, drop_reason FROM ({_selection_sql(False, 60, 25 * 1048576, None, 0)})")
def e4_select_all_profile(df):
    return selection.select_assets(df, selection.Options(profile="all")).select("page_id", "id", "drop_reason")


@query(r.ASSETS, f"SELECT page_id, id, drop_reason FROM ({_selection_sql(False, 60, 25 * 1048576, None, 900_000, "kind = 'image' AND contains(lower(name), 'hero_2')")})")
def f4_f7_named_filters(df):
    return selection.select_assets(df, selection.Options(profile="all", kinds=("image",), name_contains="Hero_2", most_file_bytes=900_000)).select("page_id", "id", "drop_reason")


@query(r.ASSETS, f"SELECT page_id, id, drop_reason FROM ({_selection_sql(True, 15, 0, 600, 8388608, "role IN ('icon', 'sprite-symbol', 'logo', 'favicon')", icons=True, sprites=True)})")
def f5_named_roles(df):
    return selection.select_assets(df, selection.Options(roles=("icon", "sprite-symbol", "logo", "favicon"), most=15, most_bytes=0)).select("page_id", "id", "drop_reason")


@query(r.ASSETS, f"SELECT page_id, id, drop_reason FROM ({_selection_sql(True, 60, 5_000_000, 900, 0, icons=True)})")
def f6_size_gate(df):
    return selection.select_assets(df, selection.Options(include_icons=True, min_long_side=900, most_file_bytes=0, most_bytes=5_000_000)).select("page_id", "id", "drop_reason")


_IDS = [f"asset:{n}" for n in range(1, 400, 3)]


@query(r.ASSETS, f"SELECT page_id, id, drop_reason FROM ({_selection_sql(True, 4, 0, None, 0, ids=f"id IN (SELECT sha1('asset:' || n) FROM range(1, 400, 3) t(n))")})")
def f3_explicit_ids(df):
    ids = tuple(hashlib.sha1(x.encode()).hexdigest() for x in _IDS)
    return selection.select_assets(df, selection.Options(ids=ids, most=4)).select("page_id", "id", "drop_reason")


@query(r.ASSETS, f"SELECT page_id, coalesce(drop_reason, 'kept') AS drop_reason, count(*) AS n, sum(bytes)::BIGINT AS bytes FROM ({_DEFAULT}) GROUP BY ALL")
def a15_drop_reasons(df):
    return selection.dropped(selection.select_assets(df, _OPTIONS))


@query(r.ASSETS, f"SELECT k.page_id, k.id AS kept_id, string_agg(d.id, ',' ORDER BY d.score DESC, d.ord, d.id) AS dropped_ids FROM ({_DEFAULT}) k JOIN ({_DEFAULT}) d ON d.page_id = k.page_id AND d.sha1 = k.sha1 AND d.drop_reason = 'duplicate' WHERE k.drop_reason IS NULL GROUP BY ALL")
def d3_duplicate_groups(df):
    return selection.duplicate_groups(selection.select_assets(df, _OPTIONS)).withColumn("dropped_ids", F.array_join("dropped_ids", ","))


@query(r.ASSETS, f"""WITH RECURSIVE a AS (SELECT page_id, ord, id, coalesce(bytes, 0) AS b, row_number() OVER (PARTITION BY page_id ORDER BY ord, id) AS n FROM {o(r.ASSETS)}),
  f AS (SELECT page_id, ord, id, n, 0::BIGINT AS batch, b AS spent FROM a WHERE n = 1 UNION ALL SELECT a.page_id, a.ord, a.id, a.n, f.batch + (f.spent + a.b > 4000000)::BIGINT, CASE WHEN f.spent + a.b > 4000000 THEN a.b ELSE f.spent + a.b END FROM f JOIN a ON a.page_id = f.page_id AND a.n = f.n + 1)
  SELECT page_id, ord, id, batch FROM f""")
def k2_batches(df):
    return ndjson.batches(df.withColumn("b", F.coalesce("bytes", F.lit(0).cast("long"))), "page_id", ["ord", "id"], "b", 4_000_000)


@query(r.ASSETS, f"SELECT 'example-assets/' || CASE WHEN kind = 'svg' THEN 'svg/' ELSE 'images/' END || filename AS path, id FROM {o(r.ASSETS)}")
def k5_zip_paths(df):
    return df.select(F.concat(F.lit("example-assets/"), F.when(F.col("kind") == "svg", "svg/").otherwise("images/"), "filename").alias("path"), "id")


@query(r.ASSETS, f"SELECT page_id, id FROM (SELECT *, dense_rank() OVER (PARTITION BY page_id ORDER BY insecure DESC, top DESC, url) AS n FROM (SELECT page_id, id, url, max(score) OVER (PARTITION BY page_id, url) AS top, url LIKE 'http:%' AS insecure FROM {o(r.ASSETS)} WHERE url IS NOT NULL)) WHERE n <= 40")
def r7_signing_cap(df):
    from pyspark.sql import Window

    top = F.max("score").over(Window.partitionBy("page_id", "url"))
    order = Window.partitionBy("page_id").orderBy(F.desc(F.col("url").startswith("http:")), F.desc("top"), "url")
    return df.filter("url is not null").withColumn("top", top).withColumn("n", F.dense_rank().over(order)).filter("n <= 40").select("page_id", "id")


@query(r.ASSETS, f"SELECT page_id, id FROM {o(r.ASSETS)} ORDER BY score DESC, ord, id LIMIT 50 OFFSET 100")
def r8_page_of_list(df):
    return df.orderBy(*assets.sort_keys("relevance")).offset(100).limit(50).select("page_id", "id")


_DECODED = "nullif(regexp_extract(html, '<title[^>]*>([^<]*)</title', 1, 's'), '')"
for _name, _mark in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "''"), ("nbsp", " "), ("amp", "&")):
    _DECODED = f"replace({_DECODED}, '&{_name};', '{_mark}')"


# The tables' titles have named references alone, and none that another one makes.
@query(None, f"SELECT page_id, trim({_DECODED}) AS title FROM pages")
def s2_titles(spark, sf_dir):
    return parsers.heads(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "title")


@query(None, """SELECT page_id, unnest(range(len(h)))::BIGINT AS pos, unnest(h) AS href FROM (SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS h FROM pages)""")
def s2_links(spark, sf_dir):
    return parsers.links(spark.read.parquet(f"{sf_dir}/pages.parquet"))


_BLOCK = "SELECT page_id, CASE WHEN page_id % 31 = 0 THEN 'cloudflare-challenge' WHEN page_id % 7 = 0 THEN 'challenge-title' WHEN page_id % 5 = 0 THEN 'http-403' END AS reason FROM pages"


@query(None, _BLOCK)
def s19_block_reason(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    n = F.col("page_id")
    title = F.when(n % 7 == 0, "Just a moment...").otherwise("Welcome")
    return p.select("page_id", rules.block_reason(F.when(n % 5 == 0, 403).otherwise(200), title, F.when(n % 31 == 0, "Challenge"), F.col("html"), F.when(n % 5 == 0, 100).otherwise(500)).alias("reason"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["q1_section_totals"](spark, sf_dir)
