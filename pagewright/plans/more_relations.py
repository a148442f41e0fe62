"""Input relations for assembly, fonts, palettes and scalar rules, in SQL that Spark and DuckDB both run."""

from __future__ import annotations

PICTURES = """
SELECT l_suppkey % 20 AS page_id, CASE WHEN l_partkey % 60 = 59 THEN concat('https://www.google-analytics.com/collect?i=', CAST(l_partkey % 7 AS STRING)) ELSE
    concat('https://cdn.example.com/img/photo', CAST(l_partkey % 60 AS STRING), CASE l_linenumber % 4 WHEN 0 THEN '_small' WHEN 1 THEN '_large' WHEN 2 THEN '@2x' ELSE '' END, CASE WHEN l_partkey % 60 % 7 = 0 THEN '.svg' ELSE '.png' END,
    CASE WHEN l_linenumber % 4 = 3 THEN '?w=300' ELSE '' END) END AS url,
  l_orderkey * 8 + l_linenumber AS ord, CASE l_linenumber % 5 WHEN 0 THEN 'img' WHEN 1 THEN 'picture' WHEN 2 THEN 'stylesheet' WHEN 3 THEN CASE WHEN l_partkey % 60 = 3 THEN 'og-image' ELSE 'img' END ELSE 'lazy-attribute' END AS found_in, CAST(NULL AS BIGINT) AS grp,
  l_quantity > 25 AS visible, l_linenumber % 5 = 2 AS declared_only, CAST(l_partkey % 60 * 10 AS DOUBLE) AS natural_w, CAST(l_linenumber * 100 AS DOUBLE) AS natural_h, CAST(l_quantity * 4 AS DOUBLE) AS rendered_w, CAST(l_linenumber * 20 AS DOUBLE) AS rendered_h,
  CASE WHEN l_partkey % 60 < 20 AND l_orderkey % 3 = 0 THEN concat('Label ', CAST(l_partkey % 60 AS STRING)) END AS label, CAST(NULL AS STRING) AS link_text, CAST(0 AS BIGINT) AS logo_score, l_partkey % 60 = 5 AS logo_word
FROM {lineitem}
"""
PICTURE_CAPTURES = """
SELECT DISTINCT l_suppkey % 20 AS page_id, concat('https://cdn.example.com/img/photo', CAST(l_partkey % 60 AS STRING), '_large', CASE WHEN l_partkey % 60 % 7 = 0 THEN '.svg' ELSE '.png' END) AS url, CAST(CASE WHEN l_partkey % 60 % 11 = 0 THEN 404 ELSE 200 END AS INT) AS status,
  CAST(NULL AS STRING) AS content_type, CAST(l_partkey % 60 * 40 AS DOUBLE) AS width, CAST(700 AS DOUBLE) AS height, CAST(l_partkey % 60 * 1000 AS BIGINT) AS bytes
FROM {lineitem} WHERE l_partkey % 60 <> 59 AND l_partkey % 60 % 3 = 0
"""
SERVICE_URLS = """
SELECT p_partkey AS id, CASE p_partkey % 12
  WHEN 0 THEN concat('https://a', CAST(n AS STRING), '.example/_next/image?url=%2Fimg%2Fp', CAST(n AS STRING), '.png&w=256&q=75') WHEN 1 THEN concat('https://images.ctfassets.net/s/', CAST(n AS STRING), '/hero.png?w=400&fm=avif')
  WHEN 2 THEN concat('https://cdn.shopify.com/s/files/', CAST(n AS STRING), '/shoe_600x.jpg?v=12&width=600') WHEN 3 THEN concat('https://site.example/wp-content/uploads/', CAST(n AS STRING), '/pic-300x200.jpg')
  WHEN 4 THEN concat('https://res.cloudinary.com/demo/image/upload/w_300,c_fill/v', CAST(n AS STRING), '/team.jpg') WHEN 5 THEN concat('https://static.wixstatic.com/media/f', CAST(n AS STRING), '.png/v1/fill/w_200,h_40/logo.png')
  WHEN 6 THEN concat('https://x.example/a/pic', CAST(n AS STRING), '@2x.png') WHEN 7 THEN concat('https://x.example/a/pic', CAST(n AS STRING), '-1500w.webp?v=3') WHEN 8 THEN concat('https://x.example/a/pic', CAST(n AS STRING), '.png?id=7')
  WHEN 9 THEN concat('https://p', CAST(n AS STRING), '.example/img?src=https%3A%2F%2Fcdn.example%2Fz.png&w=50') WHEN 10 THEN concat('https://i0.wp.com/site', CAST(n AS STRING), '.example/up/a.jpg') ELSE concat('https://u.example/photo', CAST(n AS STRING), '.jpg?w=40&q=8') END AS url, n
FROM (SELECT p_partkey, CAST(floor(p_partkey / 12) AS BIGINT) AS n FROM {part})
"""
FONT_RULES = """
SELECT c_custkey % 40 AS page_id, c_custkey AS rule, pos, CASE c_custkey % 6 WHEN 0 THEN 'Inter' WHEN 1 THEN '__Acme_Sans_d65c78' WHEN 2 THEN 'wf_3b9f' WHEN 3 THEN 'Georgia Pro' WHEN 4 THEN 'Renamed' ELSE 'inter' END AS family,
  CASE WHEN c_custkey % 4 = 0 THEN 'bold' WHEN c_custkey % 4 = 1 THEN '100 900' ELSE 'normal' END AS weight, CASE WHEN c_custkey % 5 = 0 THEN 'italic' ELSE 'normal' END AS style, 'normal' AS stretch, CASE WHEN c_custkey % 9 = 0 THEN 'U+0100-024F' END AS unicode_range,
  concat(CASE WHEN c_custkey % 10 = 7 THEN 'https://use.typekit.net/f' WHEN c_custkey % 10 < 5 THEN 'https://fonts.gstatic.com/f' ELSE 'https://static.site.example/f' END, CAST(c_custkey % 90 AS STRING), '-', CAST(pos AS STRING), CASE WHEN pos = 0 THEN '.woff' ELSE '.woff2' END) AS url,
  CASE WHEN pos = 0 THEN 'woff' ELSE 'woff2' END AS format
FROM {customer}, (SELECT 0 AS pos UNION ALL SELECT 1 AS pos) AS p
"""
FONT_FILES = """
SELECT page_id, url, format, MIN(rule) AS seq, CAST(CASE WHEN MIN(rule) % 8 = 0 THEN 404 ELSE 200 END AS INT) AS status,
  CASE WHEN MIN(k) % 5 = 0 THEN 'Inter' WHEN MIN(k) % 5 = 1 THEN 'Acme Sans' WHEN MIN(k) % 5 = 2 THEN 'Georgia' WHEN MIN(k) % 5 = 3 THEN 'Zed Mono' END AS typographic, CAST(NULL AS STRING) AS wws, CAST(NULL AS STRING) AS legacy, CAST(NULL AS STRING) AS postscript,
  MIN(k) % 7 <> 3 AS covers_latin, '400' AS weight, 'normal' AS style
FROM (SELECT c_custkey % 40 AS page_id, c_custkey AS rule, c_custkey % 90 AS k, concat(CASE WHEN c_custkey % 10 = 7 THEN 'https://use.typekit.net/f' WHEN c_custkey % 10 < 5 THEN 'https://fonts.gstatic.com/f' ELSE 'https://static.site.example/f' END, CAST(c_custkey % 90 AS STRING), '-0.woff') AS url, 'woff' AS format FROM {customer} WHERE c_custkey % 90 % 2 = 0
  UNION ALL SELECT c_custkey % 40, c_custkey, c_custkey % 90, concat('https://other.example/u', CAST(c_custkey % 90 AS STRING), '.woff2'), 'woff2' FROM {customer} WHERE c_custkey % 90 % 11 = 4) AS t
GROUP BY page_id, url, format
"""
FONT_STATUSES = """
SELECT c_custkey % 40 AS page_id, CASE c_custkey % 7 WHEN 0 THEN 'Inter' WHEN 1 THEN 'Georgia Pro' WHEN 2 THEN 'MyZedMono' WHEN 3 THEN 'serif' WHEN 4 THEN 'Renamed' ELSE 'Loose Face' END AS family, CASE WHEN c_custkey % 2 = 0 THEN '700' ELSE 'normal' END AS weight, 'normal' AS style, 'normal' AS stretch,
  CASE WHEN c_custkey % 3 = 0 THEN 'loaded' ELSE 'unloaded' END AS status
FROM {customer}
"""
FONT_USAGE = """
SELECT page_id, stack, SUM(chars) AS chars FROM (SELECT o_custkey % 40 AS page_id, CASE o_orderkey % 5 WHEN 0 THEN '"Inter", Arial, sans-serif' WHEN 1 THEN '__Acme_Sans_d65c78, Inter' WHEN 2 THEN 'Renamed, "Georgia Pro", serif' WHEN 3 THEN 'MyZedMono, monospace' ELSE 'Helvetica, Arial' END AS stack, o_orderkey % 50 AS chars FROM {orders}) AS t GROUP BY page_id, stack
"""
PAGES_OF = "SELECT DISTINCT s_suppkey % 40 AS page_id, 'www.site.example' AS host, 'Acme Shop' AS site FROM {supplier}"
PIXELS = """
SELECT o_custkey % 25 AS page_id, o_orderkey % 97 AS y, o_orderkey AS x, CAST(o_orderkey * 40503 % 256 AS INT) AS r, CAST(o_orderkey * 9176 % 251 AS INT) AS g, CAST(o_custkey * 7 % 256 AS INT) AS b, o_orderkey % 6 = 0 AS masked FROM {orders}
"""
# Short texts by part.
TEXTS = """
SELECT p_partkey AS id, p_partkey % 25 AS page_id, p_size AS n,
  CASE p_partkey % 6 WHEN 0 THEN concat(CAST(p_size AS STRING), 'x', CAST(p_size * 2 AS STRING), ' 16x16') WHEN 1 THEN 'any' WHEN 2 THEN concat('180X180 any ', CAST(p_size AS STRING), 'x4') WHEN 3 THEN '' ELSE concat(CAST(p_size AS STRING), 'x', CAST(p_size AS STRING)) END AS sizes,
  CASE p_partkey % 5 WHEN 0 THEN concat('<svg width="', CAST(p_size AS STRING), '" height="', CAST(p_size * 2 AS STRING), 'px"><path fill="#FFF"/></svg>') WHEN 1 THEN concat('<svg viewBox="0 0 ', CAST(p_size AS STRING), ' 40"><symbol id="a"><path/></symbol></svg>') WHEN 2 THEN '<svg width="100%"><symbol/><path stroke="#abc" fill="black"/></svg>'
    WHEN 3 THEN '<svg><circle/></svg>' ELSE '<g/>' END AS markup,
  CASE p_partkey % 8 WHEN 0 THEN concat('site', CAST(p_size AS STRING), '.example') WHEN 1 THEN concat('<https://x.example/', CAST(p_size AS STRING), '>.') WHEN 2 THEN concat('HTTP://U:p@X.example:80/a_(', CAST(p_size AS STRING), '))#top') WHEN 3 THEN 'ftp://x.example' WHEN 4 THEN 'x.example:8080' WHEN 5 THEN 'two words.example' WHEN 6 THEN 'localhost/#/route' ELSE 'nodots' END AS typed,
  CASE p_partkey % 9 WHEN 0 THEN 'Download PNG + SVG' WHEN 1 THEN '/OurBrand/assets' WHEN 2 THEN 'wordpress' WHEN 3 THEN 'Brand Kit' WHEN 4 THEN 'logout' WHEN 5 THEN 'site-logo' WHEN 6 THEN 'Press releases' WHEN 7 THEN concat('Get ', CAST(p_size AS STRING), ' files') ELSE 'text-brand' END AS words,
  CASE p_partkey % 5 WHEN 0 THEN '/' WHEN 1 THEN 'https://www.x.example/en-gb/' WHEN 2 THEN '/about' WHEN 3 THEN '#top' ELSE 'https://y.example/' END AS href,
  CASE p_partkey % 7 WHEN 0 THEN '#FA0' WHEN 1 THEN 'fa0c' WHEN 2 THEN '#12345678' WHEN 3 THEN '#12345' WHEN 4 THEN ' #ABCDEF ' WHEN 5 THEN 'red' ELSE concat('#0000', lpad(CAST(p_size AS STRING), 2, '0')) END AS hex,
  concat(CAST(p_partkey % 256 AS STRING), '.', CAST(p_size * 5 AS STRING), '.', CAST(p_partkey % 200 AS STRING), '.1') AS ip,
  CASE p_partkey % 6 WHEN 0 THEN '89504E470D0A1A0A00' WHEN 1 THEN 'FFD8FFE0' WHEN 2 THEN '474946383961' WHEN 3 THEN '774F4632' WHEN 4 THEN '3C7376672F3E' ELSE '424D00000000000000000000' END AS magic,
  CASE p_partkey % 4 WHEN 0 THEN 'SIL Open Font License 1.1' WHEN 1 THEN '' WHEN 2 THEN 'All rights reserved' END AS license, CASE p_partkey % 3 WHEN 0 THEN 'U+0000-00FF' WHEN 1 THEN 'U+01??' END AS unicode_range,
  CASE p_partkey % 6 WHEN 0 THEN 'sourceCodePro' WHEN 1 THEN 'Inter' WHEN 2 THEN 'open_sans-condensed' WHEN 3 THEN 'x' WHEN 4 THEN 'ABCDiatype' ELSE 'Lato' END AS family,
  CASE p_partkey % 7 WHEN 0 THEN '--brand-primary' WHEN 1 THEN '--color-primary-800' WHEN 2 THEN '--accent' WHEN 3 THEN '--text-brand' WHEN 4 THEN '--swiper-theme-color' WHEN 5 THEN '--primary-500' ELSE '--radius' END AS variable,
  CASE p_partkey % 8 WHEN 0 THEN 'tracker' WHEN 1 THEN 'pixel' WHEN 2 THEN 'consent' WHEN 3 THEN 'spacer' WHEN 4 THEN 'widget' WHEN 5 THEN 'not-image' WHEN 6 THEN 'unheard-of' ELSE 'tiny-svg' END AS reason,
  CASE p_partkey % 8 WHEN 0 THEN 'site-logo' WHEN 1 THEN 'logo' WHEN 2 THEN 'favicon' WHEN 3 THEN 'social' ELSE 'image' END AS role
FROM {part}
"""
