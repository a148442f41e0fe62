"""Registered queries over scans: lookups, manifests, limits, brand files, steps, budgets, summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import elements
from ..operators import assets, palette, scans
from . import more_relations as m
from . import relations as r
from .queries import query
from .relations import oracle_relation as o
from .relations import spark_relation

SCANS = """
SELECT event_id AS scan_id, ts AS scanned_at, CASE WHEN event_id % 3 = 0 THEN 'local' ELSE 'remote' END AS origin,
  concat(CASE WHEN event_id % 2 = 0 THEN 'https://www.x' ELSE 'https://x' END, CAST(user_id AS STRING), '.example/p', CASE WHEN event_id % 5 = 0 THEN '/' ELSE '' END, CASE WHEN event_id % 7 = 0 THEN '#top' ELSE '' END) AS url,
  concat('https://x', CAST(user_id AS STRING), '.example/home?v=', CAST(event_id % 3 AS STRING)) AS final_url
FROM {events}
"""
LINKS = """
SELECT p_partkey % 25 AS page_id, 'https://www.site.example/brand' AS page_url, p_partkey AS ord,
  CASE p_partkey % 6 WHEN 0 THEN concat('/files/kit', CAST(p_size AS STRING), '.zip') WHEN 1 THEN concat('https://cdn.example/logo', CAST(p_size AS STRING), '.SVG') WHEN 2 THEN '/about' WHEN 3 THEN concat('/files/kit', CAST(p_size AS STRING), '.zip#top') WHEN 4 THEN '/files/guide.pdf' ELSE concat('/img/x', CAST(p_size AS STRING), '.png?v=1') END AS href,
  concat('a("/brand-page/mark', CAST(p_size AS STRING), '.svg"),b(''/social/x.svg''),c("/press/kit', CAST(p_size AS STRING), '.zip?x=1"),d("/eips/list.pdf")') AS script
FROM {part}
"""


@query(SCANS, f"""WITH s AS (SELECT *, max(scanned_at) OVER () AS latest FROM {o(SCANS)}), y AS (SELECT * FROM s WHERE scanned_at >= latest - INTERVAL 20 DAY),
  k AS (SELECT scan_id, origin, scanned_at, unnest(list_distinct([regexp_replace(regexp_replace(regexp_replace(url, '#.*', ''), '/+$', ''), '//www[.]', '//'), final_url])) AS key FROM y), b AS (SELECT origin, key, arg_max(scan_id, (scanned_at, scan_id)) AS scan_id FROM k GROUP BY ALL),
  w AS (SELECT DISTINCT url, origin FROM s) SELECT w.url, w.origin, b.scan_id FROM w JOIN b ON b.origin = w.origin AND b.key = regexp_replace(regexp_replace(regexp_replace(w.url, '#.*', ''), '/+$', ''), '//www[.]', '//')""")
def s15_recent_scans(df):
    df = df.withColumn("scanned_at", F.col("scanned_at").cast("timestamp"))
    latest = df.agg(F.max("scanned_at")).first()[0]
    return scans.recent_scans(df, df, F.lit(latest), 20 * 86_400)


@query(r.ASSETS, f"SELECT page_id, id, name, filename AS file, url, kind, role, format, bytes, 'deck profile (role ' || role || ')' AS kept_because FROM {o(r.ASSETS)}")
def k7_manifest_rows(df):
    return scans.manifest_rows(df)


@query(r.ASSETS, f"SELECT filename AS file, id FROM {o(r.ASSETS)} WHERE ord % 2 = 0 UNION ALL SELECT filename, sha1(id) FROM {o(r.ASSETS)} WHERE ord % 3 = 0 AND ord % 2 <> 0 AND ord % 5 <> 0")
def k3_merged_manifest(df):
    new, old = df.filter("ord % 2 = 0").select(F.col("filename").alias("file"), "id"), df.filter("ord % 3 = 0").select(F.col("filename").alias("file"), F.sha1("id").alias("id"))
    return scans.merged_manifest(new, old, df.filter("ord % 5 <> 0").select(F.col("filename").alias("file")))


@query(r.ASSETS, f"""WITH a AS (SELECT page_id, id, ord, kind AS list, ord AS index, url, coalesce(bytes, 0) AS size FROM {o(r.ASSETS)}), b AS (SELECT *, url IS NOT NULL AND row_number() OVER (PARTITION BY page_id, url ORDER BY list, index) > 1 AS repeat, sum(size) OVER (PARTITION BY page_id) AS total FROM a)
  SELECT page_id, id FROM (SELECT *, coalesce(sum(size) OVER (PARTITION BY page_id ORDER BY repeat DESC, size DESC, index DESC, list DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gone FROM b) WHERE total - gone <= 30000000""")
def k8_fitted_output(df):
    items = df.select("page_id", "id", F.col("kind").alias("list"), F.col("ord").alias("index"), "url", F.coalesce("bytes", F.lit(0)).alias("size"))
    return scans.fitted(items, "page_id", 30_000_000).select("page_id", "id")


@query(LINKS, f"""WITH t AS (SELECT *, regexp_extract(href, '^[^#]*') AS h FROM {o(LINKS)}), l AS (SELECT page_id, 0 AS tier, ord, CASE WHEN href LIKE 'http%' THEN href ELSE 'https://www.site.example' || href END AS url, CASE WHEN h LIKE 'http%' THEN h ELSE 'https://www.site.example' || h END AS key, 'link' AS found_in FROM t),
  s AS (SELECT page_id, 1 AS tier, n AS ord, 'https://www.site.example' || p AS url, 'https://www.site.example' || p AS key, 'script' AS found_in FROM (SELECT page_id, 0 AS n, regexp_extract(script, '(/brand-page/mark[0-9]+[.]svg)', 1) AS p FROM t UNION ALL SELECT page_id, 2, regexp_extract(script, '(/press/kit[0-9]+[.]zip)', 1) FROM t)),
  u AS (SELECT *, nullif(lower(regexp_extract(regexp_extract(key, '^[^?]*'), '[.](zip|pdf|svg|png|SVG)$', 1)), '') AS type FROM (SELECT * FROM l UNION ALL SELECT * FROM s)), f AS (SELECT * FROM u WHERE type IS NOT NULL QUALIFY row_number() OVER (PARTITION BY page_id, key ORDER BY tier, ord, url) = 1),
  g AS (SELECT * FROM f WHERE NOT (type IN ('svg', 'png') AND key LIKE '%/img/x1%')) SELECT page_id, place, left(sha1(url), 12) AS id, url, type, found_in FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY tier, ord, url) AS place FROM g) WHERE place <= 60""")
def e7_brand_files(df):
    known = df.filter("href like '/img/x1%'").select("page_id", F.concat(F.lit("https://www.site.example"), "href").alias("url"))
    return scans.brand_files(df, df, known, 60)


@query(r.REQUESTS, f"""WITH e AS (SELECT client AS scan_id, request_id AS seq, ['queue', 'open', 'scroll', 'collect', 'process'][bytes % 5 + 1] AS step, bytes % 5 AS place, bytes % 11 = 0 AS done FROM {o(r.REQUESTS)}),
  g AS (SELECT scan_id, step, place, min(seq) AS first, bool_or(done) AS finished FROM e GROUP BY ALL) SELECT scan_id, step, CASE WHEN finished OR EXISTS (SELECT 1 FROM e WHERE e.scan_id = g.scan_id AND NOT e.done AND e.place > g.place AND e.step <> 'queue' AND e.seq > g.first) THEN 'done' ELSE 'active' END AS state FROM g""")
def t3_step_states(df):
    step = F.element_at(F.array(*map(F.lit, scans.STEPS)), (F.col("bytes") % 5 + 1).cast("int"))
    return scans.step_states(df.select(F.col("client").alias("scan_id"), F.col("request_id").alias("seq"), step.alias("step"), F.when(F.col("bytes") % 11 == 0, "done").otherwise("start").alias("state")))


@query(r.REQUESTS, f"""WITH RECURSIVE q AS (SELECT client AS key, epoch(ts)::BIGINT AS at_, request_id AS id, row_number() OVER (PARTITION BY client ORDER BY epoch(ts)::BIGINT, request_id) AS i FROM {o(r.REQUESTS)}),
  f AS (SELECT key, at_, id, i, at_ AS began, 1::BIGINT AS n FROM q WHERE i = 1 UNION ALL SELECT q.key, q.at_, q.id, q.i, CASE WHEN q.at_ < f.began + 259200 THEN f.began ELSE q.at_ END, CASE WHEN q.at_ < f.began + 259200 THEN f.n + 1 ELSE 1 END FROM f JOIN q ON q.key = f.key AND q.i = f.i + 1)
  SELECT id, n FROM f""")
def t8_ttl_counters(df):
    at = F.rint(F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)).cast("long")  # the nearest second, as in the SQL
    return scans.ttl_counts(df.select(F.col("client").alias("key"), at.alias("at"), F.col("request_id").alias("id")), 259_200).select("id", "n")


@query(r.ASSETS, f"SELECT page_id, id, needs AND n <= 20 AS probe FROM (SELECT page_id, id, needs, row_number() OVER (PARTITION BY page_id, needs ORDER BY score DESC, ord, id) AS n FROM (SELECT *, ord % 4 <> 0 AS needs FROM {o(r.ASSETS)}))")
def r6_probe_budget(df):
    return scans.probe_budget(df.withColumn("needs_probe", F.col("ord") % 4 != 0), 20).select("page_id", "id", "probe")


@query(r.ASSETS, f"SELECT page_id, url, CASE WHEN ord % 2 = 0 THEN ord WHEN ord % 3 = 0 THEN ord * 10 END AS bytes FROM (SELECT page_id, 'blob:' || id AS url, ord FROM {o(r.ASSETS)})")
def j2_blob_bytes(df):
    records = df.select("page_id", F.concat(F.lit("blob:"), "id").alias("url"), "ord")
    return scans.blob_bytes(records, records.filter("ord % 2 = 0").withColumn("bytes", F.col("ord")), records.filter("ord % 3 = 0").withColumn("bytes", F.col("ord") * 10)).drop("ord")


@query(r.ASSETS, f"SELECT page_id, arg_min(id, (-score, ord, id)) AS asset_id FROM {o(r.ASSETS)} WHERE ord % 7 = page_id % 7 OR sha1 = sha1('c' || page_id) GROUP BY page_id")
def j9_wordmark_assets(df):
    rows = df.withColumn("grp", F.col("ord") % 7).withColumnRenamed("sha1", "svg_hash")
    marks = df.select("page_id").distinct().select("page_id", (F.col("page_id") % 7).alias("grp"), F.sha1(F.concat(F.lit("c"), F.col("page_id").cast("string"))).alias("svg_hash"))
    return scans.wordmark_assets(marks, rows)


_ITEMS = "(SELECT page_id, id, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, ord, id) AS item FROM " + o(r.ASSETS) + ")"


@query(r.ASSETS, f"WITH i AS {_ITEMS} SELECT page_id, id FROM i WHERE item BETWEEN 2 AND 6")
def q5_range_selection(df):
    items = assets.ranked(df).select("page_id", "id", F.col("rank").alias("item"))
    end = lambda n, c: items.filter(F.col("item") == n).select("page_id", F.col("id").alias(c))
    return scans.selected_range(items, end(6, "a").join(end(2, "b"), "page_id"))


@query(r.ASSETS, f"SELECT page_id, id FROM {o(r.ASSETS)} WHERE (ord % 2 = 0) <> (ord % 3 = 0)")
def q7_toggled_selection(df):
    return scans.toggled(df.filter("ord % 2 = 0").select("page_id", "id"), df.filter("ord % 3 = 0").select("page_id", "id"))


@query(None)
def a18_summaries(spark, sf_dir):
    rows, colors = spark_relation(spark, sf_dir, r.ASSETS), spark_relation(spark, sf_dir, r.COLORS)
    families = spark_relation(spark, sf_dir, m.FONT_USAGE).groupBy("page_id").agg(F.sum("chars").alias("chars")).select("page_id", F.concat(F.lit("font-"), F.col("page_id").cast("string")).alias("id"), F.lit("Inter").alias("name"), F.lit(0.5).alias("usage"), F.lit(True).alias("used_on_page"))
    return scans.summaries(rows, palette.build_palettes(colors), families, assets.counted_noise(rows, F.when(F.col("ord") % 5 == 0, "tracker")).filter("reason <> 'kept'"))


@query(r.REQUESTS)
def t7_proxy_takes(df):
    return scans.proxy_takes(df.withColumn("ts", F.col("ts").cast("timestamp")), 40_000, 400_000)


HTMLS = """
SELECT p_partkey AS page_id, CAST(p_size AS BIGINT) AS n, concat('https://site', CAST(p_size AS STRING), '.example/x/') AS url, CASE p_partkey % 5
  WHEN 0 THEN concat('<picture><source srcset="/w', CAST(p_size AS STRING), '.webp 2x"><img src="a.png" srcset="a.png 1x, /b', CAST(p_size AS STRING), '.png 2x"></picture>') WHEN 1 THEN concat('<link rel="shortcut icon" href="/i', CAST(p_size AS STRING), '.ico"><meta property="og:image" content="https://cdn.example/o', CAST(p_size AS STRING), '.png#f">')
  WHEN 2 THEN concat('<style>/* url(no.png) */ a', chr(123), 'background:url(/k', CAST(p_size AS STRING), '.png)', chr(125), ' @font-face', chr(123), 'src:url(f.woff)', chr(125), '</style><video poster="p', CAST(p_size AS STRING), '.jpg"></video>')
  WHEN 3 THEN concat('<script type="application/ld+json">', chr(123), '"logo":', chr(123), '"url":"/l', CAST(p_size AS STRING), '.svg"', chr(125), '', chr(125), '</script><link rel="manifest" href="/m.json"><div style="background:url(''../q.png'')">') END AS html,
  CASE WHEN p_partkey % 3 = 0 THEN concat('', chr(123), '"icons":[', chr(123), '"src":"i', CAST(p_size AS STRING), '.png","sizes":"8x8"', chr(125), ',', chr(123), '"sizes":"1x1"', chr(125), ',', chr(123), '"src":"j.svg","type":"image/svg+xml"', chr(125), ']', chr(125), '') WHEN p_partkey % 3 = 1 THEN 'junk' END AS body,
  CASE p_partkey % 5 WHEN 0 THEN concat('rgb(', CAST(p_size AS STRING), ', 2, 3)') WHEN 1 THEN 'rgba(0, 0, 0, 0.01)' WHEN 2 THEN '#0a0b0c' WHEN 3 THEN concat('RGBA(', CAST(p_size AS STRING), ',0,0,1)') ELSE 'red' END AS color
FROM {part}
"""


@query(HTMLS, f"""WITH h AS (SELECT *, 'https://site' || n || '.example' AS o FROM {o(HTMLS)})
  SELECT page_id, unnest(range(4)) AS ord, unnest(['img', 'img', 'img', 'picture']) AS found_in, unnest([url || 'a.png', url || 'a.png', o || '/b' || n || '.png', o || '/w' || n || '.webp']) AS url, unnest([NULL, 1, 2, 2])::DOUBLE AS x FROM h WHERE page_id % 5 = 0
  UNION ALL SELECT page_id, unnest(range(2)), unnest(['icon-link', 'og-image']), unnest([o || '/i' || n || '.ico', 'https://cdn.example/o' || n || '.png']), NULL FROM h WHERE page_id % 5 = 1
  UNION ALL SELECT page_id, unnest(range(2)), unnest(['stylesheet', 'video-poster']), unnest([o || '/k' || n || '.png', url || 'p' || n || '.jpg']), NULL FROM h WHERE page_id % 5 = 2
  UNION ALL SELECT page_id, unnest(range(3)), unnest(['json-ld', 'css-background', 'manifest-link']), unnest([o || '/l' || n || '.svg', o || '/q.png', o || '/m.json']), NULL FROM h WHERE page_id % 5 = 3""")
def s3_s6_candidates(df):
    return elements.candidates(df).select("page_id", "ord", "found_in", "url", "x")


@query(HTMLS, f"SELECT page_id, unnest([0, 2])::BIGINT AS pos, unnest(['i' || n || '.png', 'j.svg']) AS src, unnest(['8x8', NULL]) AS sizes, unnest([NULL, 'image/svg+xml']) AS type FROM {o(HTMLS)} WHERE page_id % 3 = 0")
def s9_manifest_icons(df):
    return elements.manifest_icons(df)


@query(HTMLS, f"SELECT page_id, CASE page_id % 5 WHEN 0 THEN '#' || lpad(lower(to_hex(n)), 2, '0') || '0203' WHEN 2 THEN '#0a0b0c' WHEN 3 THEN '#' || lpad(lower(to_hex(n)), 2, '0') || '0000' END AS hex FROM {o(HTMLS)}")
def p32_css_colors(df):
    white = F.struct(*[F.lit(255.0).alias(n) for n in "rgb"])
    return df.select("page_id", elements.over(elements.css_color(F.col("color")), white).alias("hex"))
