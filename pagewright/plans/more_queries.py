"""Registered queries over assembly, fonts, palettes and scalar rules, each with SQL of its own."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import font_names, labels, pictures, rules, urls, variables
from ..operators import assembly, fonts, palette
from ..sources import ndjson
from . import more_relations as m
from . import relations as r
from .queries import query
from .relations import oracle_relation as o
from .relations import spark_relation

# -- scalar rules ---------------------------------------------------------------------------------------------------


def scalar(name: str, sql: str, columns):
    """A query of TEXTS: id and the columns (made when a session is there); ``sql`` has an expression for each."""

    def f(df):
        return df.select("id", *[x.alias(k) for k, x in columns().items()])

    f.__name__ = name
    return query(m.TEXTS, f"SELECT id, {sql} FROM {o(m.TEXTS)}")(f)


c = lambda name: F.col(name)
scalar("p1_typed_urls", "CASE id % 8 WHEN 0 THEN 'https://site' || n || '.example/' WHEN 1 THEN 'https://x.example/' || n WHEN 2 THEN 'http://x.example/a_(' || n || '))' WHEN 6 THEN 'https://localhost/#/route' END AS url", lambda: dict(url=urls.typed_url(c("typed"))))
scalar("p11_icon_sizes", "CASE id % 6 WHEN 0 THEN CASE WHEN 2 * n * n >= 256 THEN n ELSE 16 END WHEN 2 THEN CASE WHEN n * 4 > 32400 THEN n ELSE 180 END WHEN 4 THEN n WHEN 5 THEN n END::BIGINT AS width", lambda: dict(width=pictures.largest_icon_size(c("sizes"))["width"]))
scalar("p12_svg_sizes", "CASE id % 5 WHEN 0 THEN n WHEN 1 THEN n END::DOUBLE AS width, CASE id % 5 WHEN 0 THEN n * 2 WHEN 1 THEN 40 END::DOUBLE AS height", lambda: dict(width=pictures.svg_size(c("markup"))["width"], height=pictures.svg_size(c("markup"))["height"]))
scalar("p13_data_uris", "'text/css' AS mime, 'n' || n || ' a' AS text", lambda: dict(mime=pictures.data_uri(F.concat(F.lit("data:text/css;base64,"), F.base64(F.concat(F.lit("n"), c("n").cast("string"), F.lit(" a")).cast("binary"))))["mime"], text=pictures.data_uri(F.concat(F.lit("data:text/css,n"), c("n").cast("string"), F.lit("%20a")))["bytes"].cast("string")))
scalar("p15_sniffed_formats", "CASE id % 6 WHEN 0 THEN 'png' WHEN 1 THEN 'jpg' WHEN 2 THEN 'gif' WHEN 3 THEN 'other' WHEN 4 THEN 'svg' ELSE 'bmp' END AS format, CASE id % 6 WHEN 3 THEN 'bin' WHEN 0 THEN 'png' WHEN 1 THEN 'jpg' WHEN 2 THEN 'gif' WHEN 4 THEN 'svg' ELSE 'bmp' END AS extension", lambda: dict(format=pictures.sniffed_format(F.unhex("magic")), extension=pictures.extension(pictures.sniffed_format(F.unhex("magic")))))
scalar("p21_p25_svg_rules", "CASE WHEN n < 6 THEN 'tiny-svg' END AS reason, id % 5 = 1 AS sheet", lambda: dict(reason=pictures.svg_noise(c("markup"), F.lit(True), c("n").cast("double"), F.lit(1.0)), sheet=pictures.is_sprite_sheet(c("markup"))))
scalar("p31_colors_declared", "CASE id % 7 WHEN 0 THEN '#ffaa00' WHEN 1 THEN '#ffaa00' WHEN 2 THEN '#123456' WHEN 4 THEN '#abcdef' WHEN 6 THEN '#0000' || lpad(n::VARCHAR, 2, '0') END AS hex, CASE id % 5 WHEN 0 THEN '#ffffff' WHEN 2 THEN '#aabbcc,#000000' WHEN 4 THEN '' ELSE '#000000' END AS declared", lambda: dict(hex=pictures.normal_hex(c("hex")), declared=F.array_join(pictures.svg_colors(c("markup"))["hex"], ",")))
scalar("p33_variable_scores", "round(CASE id % 7 WHEN 0 THEN 1 WHEN 1 THEN 0.8 * 0.3 WHEN 2 THEN 0.6 WHEN 5 THEN 0.8 ELSE 0 END, 6)::DOUBLE AS score", lambda: dict(score=F.round(variables.name_score(c("variable")), 6)))
scalar("p36_licenses", "CASE id % 4 WHEN 0 THEN 'open' WHEN 2 THEN 'commercial' ELSE 'unknown' END AS kind", lambda: dict(kind=rules.license_kind(F.lit("self-hosted"), c("license"), F.lit(""), F.lit(""))))
scalar("p10_latin_ranges", "id % 3 <> 1 AS latin", lambda: dict(latin=rules.covers_latin(c("unicode_range"))))
scalar("p38_spellings", "CASE id % 6 WHEN 0 THEN 'sourceCodePro|source Code Pro|Source Code Pro' WHEN 1 THEN 'Inter' WHEN 2 THEN 'open sans condensed|Open Sans Condensed' WHEN 3 THEN '' WHEN 4 THEN 'ABCDiatype|ABC Diatype' ELSE 'Lato' END AS names", lambda: dict(names=F.array_join(font_names.spellings(c("family")), "|")))
scalar("p40_brand_words", "id % 9 IN (1, 3, 5, 6, 8) AS word, id % 9 = 3 AS strong, id % 9 IN (0, 7) AS generic, id % 9 IN (1, 3, 5) AS logo", lambda: dict(word=urls.is_brand_word(c("words")), strong=urls.is_strong_brand(c("words")), generic=urls.is_generic_label(c("words")), logo=urls.has_logo_word(c("words"))))
scalar("x2_home_links", "id % 5 < 2 AS home", lambda: dict(home=urls.is_home(c("href"), F.lit("https://x.example/p"))))
scalar("p46_file_names", "'a-b' || n || '.png' AS written, 'exa-mple' || n || '.com' AS host", lambda: dict(written=labels.written_name(F.concat(F.lit("../x/a:b"), c("n").cast("string"), F.lit(".exe")), c("id").cast("string"), F.lit("png")), host=labels.safe_host(F.concat(F.lit("WWW.Exa mple"), c("n").cast("string"), F.lit(".com")))))
scalar("p49_labels", "CASE WHEN id % 8 = 2 THEN 'Favicon' WHEN id % 8 = 3 THEN 'OG image' WHEN id % 8 < 2 THEN 'Logo' END AS badge, CASE WHEN n < 60 THEN n || 's' END AS took, n || '×' || (n * 2) AS size", lambda: dict(badge=labels.badge(c("role"), F.lit("images")), took=labels.duration(c("n") * 1000), size=labels.dimensions(c("n").cast("double"), c("n") * 2.0)))


@query(m.TEXTS, f"SELECT id, ip, NOT (a IN (0, 10, 127) OR a >= 224 OR (a = 100 AND b BETWEEN 64 AND 127) OR (a = 169 AND b = 254) OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b = 168) OR (a = 192 AND b = 0 AND d IN (0, 2)) OR (a = 192 AND b = 88 AND d = 99) OR (a = 198 AND b IN (18, 19)) OR (a = 198 AND b = 51 AND d = 100) OR (a = 203 AND b = 0 AND d = 113)) AS public FROM (SELECT id, ip, split_part(ip, '.', 1)::INT AS a, split_part(ip, '.', 2)::INT AS b, split_part(ip, '.', 3)::INT AS d FROM {o(m.TEXTS)})")
def p48_public_addresses(df):
    return df.select("id", "ip", urls.is_public_ipv4(c("ip")).alias("public"))


_PHRASE = "CASE reason WHEN 'tracker' THEN 'tracking pixels' WHEN 'pixel' THEN 'tracking pixels' WHEN 'consent' THEN 'consent banners' WHEN 'spacer' THEN 'spacer images' WHEN 'widget' THEN 'third-party widgets' WHEN 'not-image' THEN 'broken files' WHEN 'tiny-svg' THEN 'tiny SVGs' ELSE '' END"
_PLACED = "CASE many WHEN 'tracking pixels' THEN 0 WHEN 'spacer images' THEN 2 WHEN 'broken files' THEN 5 WHEN 'consent banners' THEN 6 WHEN 'third-party widgets' THEN 7 ELSE 12 END"


@query(m.TEXTS, f"""WITH p AS (SELECT page_id, {_PHRASE} AS many, count(*) * 2 AS n FROM {o(m.TEXTS)} GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY n DESC, {_PLACED}) AS place FROM p WHERE many <> ''),
  s AS (SELECT page_id, list(many ORDER BY place) FILTER (place <= 3) AS shown, sum(n) FILTER (place > 3) AS rest FROM k GROUP BY page_id), t AS (SELECT page_id, sum(n)::BIGINT AS total, coalesce(sum(n) FILTER (many = ''), 0) AS odd FROM p GROUP BY page_id),
  l AS (SELECT page_id, total, CASE WHEN coalesce(rest, 0) + odd > 0 THEN list_append(coalesce(shown, []), 'other files') ELSE shown END AS x FROM t LEFT JOIN s USING (page_id))
  SELECT page_id, format('{{:,}}', total) || ' hidden: ' || CASE WHEN len(x) = 1 THEN x[1] ELSE array_to_string(x[1:len(x) - 1], ', ') || ' and ' || x[len(x)] END AS summary FROM l""")
def a16_hidden_summary(df):
    return labels.hidden_summary(df.groupBy("page_id", "reason").agg((F.count(F.lit(1)) * 2).alias("n")))


# -- originals, names, assembly -------------------------------------------------------------------------------------


@query(m.SERVICE_URLS, f"""SELECT id, CASE id % 12 WHEN 0 THEN 'https://a' || n || '.example/img/p' || n || '.png' WHEN 1 THEN 'https://images.ctfassets.net/s/' || n || '/hero.png' WHEN 2 THEN 'https://cdn.shopify.com/s/files/' || n || '/shoe.jpg?v=12'
  WHEN 3 THEN 'https://site.example/wp-content/uploads/' || n || '/pic.jpg' WHEN 4 THEN 'https://res.cloudinary.com/demo/image/upload/v' || n || '/team.jpg' WHEN 5 THEN 'https://static.wixstatic.com/media/f' || n || '.png' WHEN 9 THEN 'https://cdn.example/z.png'
  WHEN 10 THEN 'https://site' || n || '.example/up/a.jpg' WHEN 11 THEN 'https://u.example/photo' || n || '.jpg' END AS original,
  CASE id % 12 WHEN 0 THEN 'https://a' || n || '.example/img/p' || n || '.png' WHEN 1 THEN 'https://images.ctfassets.net/s/' || n || '/hero.png' WHEN 2 THEN 'https://cdn.shopify.com/s/files/' || n || '/shoe.jpg' WHEN 3 THEN 'https://site.example/wp-content/uploads/' || n || '/pic.jpg'
  WHEN 4 THEN 'https://res.cloudinary.com/demo/image/upload/v' || n || '/team.jpg' WHEN 5 THEN 'https://static.wixstatic.com/media/f' || n || '.png' WHEN 6 THEN 'https://x.example/a/pic' || n || '.png' WHEN 7 THEN 'https://x.example/a/pic' || n || '.webp' WHEN 8 THEN 'https://x.example/a/pic' || n || '.png?id=7'
  WHEN 9 THEN 'https://cdn.example/z.png' WHEN 10 THEN 'https://site' || n || '.example/up/a.jpg' ELSE 'https://u.example/photo' || n || '.jpg' END AS variant_key,
  CASE id % 12 WHEN 0 THEN 'p' || n WHEN 1 THEN 'hero' WHEN 2 THEN 'shoe' WHEN 3 THEN 'pic' WHEN 4 THEN 'team' WHEN 5 THEN 'f' || n WHEN 9 THEN 'z' WHEN 10 THEN 'a' WHEN 11 THEN 'photo' || n WHEN 7 THEN 'pic' || n || '-1500w' ELSE 'pic' || n END AS base_name FROM {o(m.SERVICE_URLS)}""")
def p16_p18_originals(df):
    from ..functions import originals

    return originals.with_originals(df.select("id", "url")).select("id", F.get("originals", F.lit(0)).alias("original"), "variant_key", "base_name")


_ASSEMBLY = f"""WITH c AS {o(m.PICTURES)}, k AS {o(m.PICTURE_CAPTURES)},
  u AS (SELECT page_id, url, min(ord) AS ord, arg_max(natural_w * natural_h, (natural_w * natural_h, -ord)) AS area, max(natural_w * natural_h) AS nat FROM c GROUP BY ALL),
  a AS (SELECT page_id, url, ord, nat, false AS alone FROM u UNION ALL SELECT k.page_id, k.url, (SELECT max(ord) FROM u x WHERE x.page_id = k.page_id) + 1, NULL, true FROM k ANTI JOIN u USING (page_id, url) WHERE status BETWEEN 200 AND 399),
  n AS (SELECT a.*, k.status, k.width * k.height AS decoded, CASE WHEN k.status NOT BETWEEN 200 AND 399 THEN 'not-image' WHEN a.url LIKE '%google-analytics%' THEN 'tracker' END AS reason FROM a LEFT JOIN k USING (page_id, url)),
  v AS (SELECT *, regexp_replace(regexp_replace(url, '[?].*', ''), '(_small|_large|@2x)[.]', '.') AS variant, coalesce(nullif(decoded, 0), nullif(nat, 0), 0) AS size FROM n WHERE reason IS NULL),
  b AS (SELECT page_id, variant, arg_max(url, ((status IS NOT NULL)::INT, size, -ord, url)) AS url, count(*) AS members FROM v GROUP BY ALL),
  s AS (SELECT c.*, v.variant FROM c JOIN v USING (page_id, url) UNION ALL BY NAME SELECT page_id, variant, 'network' AS found_in, ord, false AS visible, false AS declared_only FROM v WHERE alone),
  f AS (SELECT page_id, variant, min(ord) AS ord, bool_or(visible) AS visible, arg_min(label, ord) FILTER (label IS NOT NULL) AS label, bool_or(logo_word) AS word, list(DISTINCT found_in) AS places, max(found_in = 'og-image') AS social,
    arg_max(rendered_w, (rendered_w * rendered_h, -ord)) FILTER (visible) AS rw, arg_max(rendered_h, (rendered_w * rendered_h, -ord)) FILTER (visible) AS rh FROM s GROUP BY ALL),
  w AS (SELECT b.*, f.* EXCLUDE (page_id, variant), CASE WHEN b.url LIKE '%.svg%' THEN 'svg' ELSE 'image' END AS kind, coalesce(k.width, arg.natural_w, 0) AS width, coalesce(k.height, arg.natural_h, 0) AS height FROM b JOIN f USING (page_id, variant) LEFT JOIN k ON k.page_id = b.page_id AND k.url = b.url
    LEFT JOIN (SELECT page_id, url, arg_max(natural_w, (natural_w * natural_h, -ord)) AS natural_w, arg_max(natural_h, (natural_w * natural_h, -ord)) AS natural_h FROM c GROUP BY ALL) arg ON arg.page_id = b.page_id AND arg.url = b.url),
  x AS (SELECT *, rw > 0 AND rh > 0 AS drawn, CASE WHEN rw > 0 AND rh > 0 THEN rw * rh WHEN kind = 'svg' THEN 0 ELSE width * height END AS shown, CASE WHEN rw > 0 AND rh > 0 THEN greatest(rw, rh) ELSE greatest(width, height) END AS long, CASE WHEN rw > 0 AND rh > 0 THEN least(rw, rh) ELSE least(width, height) END AS short FROM w),
  y AS (SELECT *, CASE WHEN social THEN 'social' WHEN word AND shown <= 120000 AND NOT (short > 0 AND long > 30 * short) THEN 'logo' WHEN coalesce(nullif(greatest(coalesce(rw, 0), coalesce(rh, 0)), 0), greatest(width, height)) BETWEEN 0.5 AND 48 THEN 'icon' WHEN kind = 'svg' THEN 'illustration' ELSE 'image' END AS role FROM x),
  z AS (SELECT *, CASE role WHEN 'social' THEN 200 WHEN 'logo' THEN 500 WHEN 'icon' THEN 10 ELSE 100 END + CASE WHEN visible THEN least(coalesce(rw, 0) * coalesce(rh, 0) / 1000, 90) + 50 ELSE 0 END - 0.01 * ord AS score, sha1(variant) AS id FROM y),
  q AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, ord, id) AS rank FROM z),
  t AS (SELECT q.*, coalesce(label, CASE WHEN role = 'social' THEN p.site || ' social image' END, regexp_extract(variant, '/(photo[0-9]+)[.]', 1)) AS name FROM q LEFT JOIN {o(m.PAGES_OF)} p USING (page_id)),
  g AS (SELECT *, 'acme-shop-' || lower(replace(name, 'Acme Shop ', '')) AS stem, CASE WHEN kind = 'svg' THEN 'svg' ELSE 'png' END AS ext FROM t)"""


def _assembled(spark, sf_dir):
    return assembly.assemble(*[spark_relation(spark, sf_dir, x) for x in (m.PICTURES, m.PICTURE_CAPTURES, m.PAGES_OF)])


@query(None, _ASSEMBLY + """ SELECT page_id, id, kind, role, members, url, visible, ord, rank, round(score, 6)::DOUBLE AS score, name,
  replace(stem, ' ', '-') || CASE WHEN count(*) OVER w > 1 THEN '-' || count(*) OVER w ELSE '' END || '.' || ext AS filename FROM g WINDOW w AS (PARTITION BY page_id, stem, ext ORDER BY rank ROWS UNBOUNDED PRECEDING)""")
def e1_assemble_assets(spark, sf_dir):
    out, _ = _assembled(spark, sf_dir)
    return out.select("page_id", "id", "kind", "role", "members", "url", "visible", "ord", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"), "name", "filename")


@query(None, _ASSEMBLY + " SELECT page_id, reason, count(*) AS n FROM n WHERE reason IS NOT NULL GROUP BY ALL")
def e1_hidden(spark, sf_dir):
    return _assembled(spark, sf_dir)[1]


@query(r.REQUESTS, f"SELECT client AS page_id, count(*) FILTER (o <> 'captured') AS attempted, count(*) FILTER (o = 'adopted') AS adopted, count(*) FILTER (o = 'captured') AS captured, count(*) FILTER (o = 'failed') AS failed, count(*) FILTER (o = 'noise') AS noise, count(*) FILTER (o = 'skipped') AS skipped FROM (SELECT client, ['adopted', 'captured', 'failed', 'noise', 'skipped'][bytes % 5 + 1] AS o FROM {o(r.REQUESTS)}) GROUP BY client")
def a17_probe_counters(df):
    outcome = F.element_at(F.array(*map(F.lit, ("adopted", "captured", "failed", "noise", "skipped"))), (c("bytes") % 5 + 1).cast("int"))
    return assembly.probe_counters(df.select(c("client").alias("page_id"), outcome.alias("outcome")))


@query(r.ASSETS, f"SELECT page_id, id FROM {o(r.ASSETS)} WHERE contains(lower(name), 'hero_1') AND (kind = 'svg' OR greatest(width, height) >= 700)")
def f8_listing(df):
    return assembly.listed(df, min_long_side=700, name_contains="Hero_1").select("page_id", "id")


@query(r.ASSETS, f"SELECT id, true AS known FROM {o(r.ASSETS)} WHERE ord % 3 = 1 UNION ALL SELECT sha1('none:' || ord), false FROM {o(r.ASSETS)} WHERE ord % 3 = 2")
def u5_requested_ids(df):
    asked = df.select(F.when(c("ord") % 3 == 1, c("id")).when(c("ord") % 3 == 2, F.sha1(F.concat(F.lit("none:"), c("ord").cast("string")))).alias("id")).filter("id is not null")
    there, unknown = assembly.requested(df, asked)
    return there.select("id", F.lit(True).alias("known")).union(unknown.select("id", F.lit(False)))


@query(m.TEXTS, f"SELECT page_id, sha1(h) AS hash, min(id) AS ord, sum(n)::BIGINT AS used_count, bool_or(n > 25) AS visible, arg_min('label ' || id, id) FILTER (id % 2 = 0) AS label FROM (SELECT *, CASE id % 5 WHEN 1 THEN '<svg viewBox=\"0 0 ' || n || ' 40\"><symbol id=\"i0\"><path/></symbol></svg>' ELSE markup END AS h FROM {o(m.TEXTS)}) GROUP BY page_id, h")
def d6_svg_merge(df):
    svgs = df.select("page_id", "markup", c("id").alias("ord"), c("n").cast("long").alias("used_count"), (c("n") > 25).alias("visible"), F.lit(1.0).alias("width"), F.lit(2.0).alias("height"), F.when(c("id") % 2 == 0, F.concat(F.lit("label "), c("id").cast("string"))).alias("label"))
    return assembly.merged_svgs(svgs).drop("width", "height")


@query(m.TEXTS, f"SELECT s.page_id, s.symbol, coalesce(u.n, 0) AS n, CASE WHEN u.n IS NULL THEN 'unreferenced-symbol' END AS reason FROM (SELECT DISTINCT page_id, 's' || n AS symbol FROM {o(m.TEXTS)}) s LEFT JOIN (SELECT page_id, 's' || (n * 2) AS symbol, count(*) AS n FROM {o(m.TEXTS)} GROUP BY ALL) u USING (page_id, symbol)")
def j12_sprite_uses(df):
    name = lambda x: F.concat(F.lit("s"), x.cast("string")).alias("symbol")
    return assembly.sprite_uses(df.select("page_id", name(c("n"))).distinct(), df.select("page_id", name(c("n") * 2)))


@query(r.ASSETS, f"SELECT ord, strlen(to_json({{'ord': ord, 'name': name}})) + 1 AS line_bytes FROM {o(r.ASSETS)}")
def k1_line_bytes(df):
    return ndjson.line_bytes(df.select("ord", "name")).select("ord", "line_bytes")


# -- fonts ----------------------------------------------------------------------------------------------------------

_FONT_NAMES = "CASE WHEN css IS NULL THEN b WHEN css = '__Acme_Sans_d65c78' THEN coalesce(b, 'Acme Sans') WHEN css = 'wf_3b9f' THEN coalesce(b, css) WHEN css = 'Georgia Pro' AND b = 'Georgia' THEN b WHEN lower(css) = 'inter' AND b = 'Inter' THEN b WHEN css = 'MyZedMono' AND b = 'Zed Mono' THEN b ELSE css END"
_FONTS = f"""WITH r AS {o(m.FONT_RULES)}, k AS (SELECT * FROM {o(m.FONT_FILES)} WHERE status = 200), s AS (SELECT * FROM {o(m.FONT_STATUSES)} WHERE status = 'loaded'),
  w AS (SELECT *, CASE weight WHEN 'bold' THEN '700' WHEN 'normal' THEN '400' ELSE weight END AS wt FROM r), l AS (SELECT DISTINCT page_id, lower(family) AS family, CASE weight WHEN 'normal' THEN '400' ELSE weight END AS wt FROM s),
  e AS (SELECT w.*, k.url IS NOT NULL AS captured, k.typographic AS b, k.covers_latin AS latin FROM w LEFT JOIN k USING (page_id, url)),
  p AS (SELECT page_id, rule, arg_min(url, (NOT captured, CASE WHEN captured THEN 0 ELSE CASE format WHEN 'woff2' THEN 0 ELSE 1 END END, pos)) AS url FROM e GROUP BY ALL),
  x AS (SELECT e.page_id, e.rule AS seq, e.family AS css, e.url, e.captured, e.b, e.wt, e.style, coalesce(e.unicode_range IS NULL, true) AND coalesce(e.latin, true) AS latin, e.captured OR (l.family IS NOT NULL AND e.style = 'normal') AS loaded,
    'css:' || CASE lower(e.family) WHEN '__acme_sans_d65c78' THEN 'acme sans' ELSE lower(e.family) END AS grp FROM e JOIN p USING (page_id, rule, url) LEFT JOIN l ON l.page_id = e.page_id AND l.family = lower(e.family) AND l.wt = e.wt),
  d AS (SELECT k.* FROM k ANTI JOIN r USING (page_id, url)), g AS (SELECT DISTINCT page_id, family FROM s WHERE family <> 'serif' AND NOT EXISTS (SELECT 1 FROM r WHERE r.page_id = s.page_id AND lower(r.family) = lower(s.family))),
  o AS (SELECT DISTINCT d.page_id, d.typographic AS b, g.family FROM d JOIN g USING (page_id) WHERE (d.typographic = 'Zed Mono' AND g.family = 'MyZedMono') OR lower(d.typographic) = lower(g.family) OR (d.typographic = 'Georgia' AND g.family = 'Georgia Pro')),
  q AS (SELECT page_id, count(*) AS n, min(family) AS family FROM g WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.page_id = g.page_id AND o.family = g.family) GROUP BY page_id),
  f AS (SELECT * FROM x UNION ALL BY NAME SELECT d.page_id, seq + 1099511627776 AS seq, o.family AS css, d.url, true AS captured, typographic AS b, '400' AS wt, 'normal' AS style, covers_latin AS latin, true AS loaded, 'bin:' || lower(typographic) AS grp FROM d LEFT JOIN o ON o.page_id = d.page_id AND o.b = d.typographic WHERE typographic IS NOT NULL
    UNION ALL BY NAME SELECT d.page_id, seq + 1099511627776 AS seq, q.family AS css, d.url, true AS captured, NULL AS b, '400' AS wt, 'normal' AS style, covers_latin AS latin, true AS loaded, 'registered:' || lower(q.family) AS grp FROM d JOIN q ON q.page_id = d.page_id AND q.n = 1 WHERE typographic IS NULL),
  ra AS (SELECT *, CASE WHEN loaded AND b IS NOT NULL AND latin THEN 0 WHEN b IS NOT NULL AND latin THEN 1 WHEN b IS NOT NULL THEN 2 ELSE 3 END AS rk FROM f),
  nm AS (SELECT page_id, grp, {_FONT_NAMES} AS family FROM (SELECT page_id, grp, arg_min(b, (rk, seq)) FILTER (b IS NOT NULL AND rk = mn) AS b, coalesce(arg_min(css, (rk, seq)) FILTER (rk = mn), arg_min(css, seq) FILTER (css IS NOT NULL)) AS css FROM (SELECT *, min(rk) OVER (PARTITION BY page_id, grp) AS mn FROM ra) GROUP BY ALL)),
  a AS (SELECT ra.*, nm.family, lower(nm.family) AS key, CASE WHEN url LIKE '%gstatic%' THEN 'google-fonts' WHEN url LIKE '%typekit%' THEN 'adobe-fonts' WHEN url LIKE '%site.example%' THEN 'self-hosted' ELSE 'third-party' END AS source FROM ra JOIN nm USING (page_id, grp))"""


def _font_inputs(spark, sf_dir):
    return [spark_relation(spark, sf_dir, x) for x in (m.FONT_RULES, m.FONT_FILES, m.FONT_STATUSES)]


@query(None, f"{_FONTS} SELECT page_id, url, family, grp, loaded, latin AS covers_latin, source FROM a")
def d9_font_groups(spark, sf_dir):
    files = fonts.named_groups(fonts.grouped_files(*_font_inputs(spark, sf_dir)))
    return files.select("page_id", "url", "family", "grp", "loaded", "covers_latin", font_names.file_source(rules.url_host(c("url")), F.lit("www.site.example")).alias("source"))


_USED = f"""{_FONTS}, ld AS (SELECT DISTINCT page_id, lower(css) AS name FROM a WHERE captured AND css IS NOT NULL UNION SELECT page_id, lower(b) FROM a WHERE grp NOT LIKE 'css:%' AND b IS NOT NULL UNION SELECT page_id, lower(family) FROM s),
  cl AS (SELECT page_id, name, arg_min(key, (pref, seq)) AS key FROM (SELECT page_id, lower(css) AS name, key, 0 AS pref, seq FROM a WHERE css IS NOT NULL UNION ALL SELECT page_id, key, key, 1, seq FROM a WHERE grp NOT LIKE 'css:%') GROUP BY ALL),
  us AS (SELECT *, sum(chars) OVER (PARTITION BY page_id) AS total FROM {o(m.FONT_USAGE)}), st AS (SELECT page_id, stack, chars, total, unnest(string_split(replace(lower(stack), '"', ''), ', ')) AS name, unnest(range(9)[1:len(string_split(stack, ', '))]) AS pos FROM us),
  fi AS (SELECT page_id, stack, chars, total, arg_min(name, pos) AS name FROM st SEMI JOIN ld USING (page_id, name) GROUP BY ALL), ch AS (SELECT page_id, key, sum(chars)::BIGINT AS chars, floor(sum(chars) / max(total)::DOUBLE * 10000 + 0.5) / 10000 AS usage FROM fi JOIN cl USING (page_id, name) GROUP BY ALL)"""


@query(None, f"{_USED} SELECT page_id, key, chars, usage::DOUBLE AS usage FROM ch")
def a7_font_usage(spark, sf_dir):
    faces, files, statuses = _font_inputs(spark, sf_dir)
    named = fonts.named_groups(fonts.grouped_files(faces, files, statuses))
    return fonts.usage_shares(spark_relation(spark, sf_dir, m.FONT_USAGE), named, statuses)


@query(None, f"""{_USED} SELECT page_id, 'font-' || replace(replace(key, ' ', '-'), '_', '-') AS id, name, css_families, source, usage, used_on_page, files FROM (SELECT a.page_id, key, arg_min(family, seq) AS name, coalesce(string_agg(DISTINCT css, ',' ORDER BY css), '') AS css_families,
  CASE WHEN bool_or(source = 'adobe-fonts') THEN 'adobe-fonts' ELSE arg_min(source, (rk, seq)) END AS source, coalesce(any_value(ch.usage), 0)::DOUBLE AS usage, bool_or(loaded) OR coalesce(any_value(ch.chars), 0) > 0 AS used_on_page, count(DISTINCT url) AS files FROM a LEFT JOIN ch USING (page_id, key) GROUP BY a.page_id, key)""")
def e3_font_families(spark, sf_dir):
    usage, pages = (spark_relation(spark, sf_dir, x) for x in (m.FONT_USAGE, m.PAGES_OF))
    every = spark_relation(spark, sf_dir, m.FONT_RULES).select("page_id").distinct().withColumn("host", F.lit("www.site.example"))
    return fonts.build_families(*_font_inputs(spark, sf_dir), usage, every).drop("faces")


def _listed_files(df):
    return df.select("page_id", c("family"), F.when(c("rule") % 17 == 0, "adobe-fonts").otherwise("self-hosted").alias("source"), "url", F.when(c("rule") % 4 == 0, "eot").when(c("rule") % 4 == 1, "ttf").otherwise(c("format")).alias("format"), "weight", "style", (c("rule") % 2 == 0).alias("loaded"), (c("rule") % 3 == 0).alias("covers_latin"), (c("rule") * 2 + c("pos")).alias("seq"))


_FILES = f"(SELECT page_id, family, CASE WHEN rule % 17 = 0 THEN 'adobe-fonts' ELSE 'self-hosted' END AS source, url, CASE rule % 4 WHEN 0 THEN 'eot' WHEN 1 THEN 'ttf' ELSE format END AS format, CASE weight WHEN 'bold' THEN 700 WHEN 'normal' THEN 400 END AS w, style, rule % 2 = 0 AS loaded, rule % 3 = 0 AS latin, rule * 2 + pos AS seq FROM {o(m.FONT_RULES)})"


@query(m.FONT_RULES, f"SELECT page_id, family, CASE WHEN adobe THEN 'adobe-fonts' WHEN NOT a THEN 'no-latin-file' WHEN NOT b THEN 'unsupported-format' END AS reason, CASE WHEN NOT adobe AND a AND b THEN url END AS url FROM (SELECT page_id, family, bool_or(source = 'adobe-fonts') AS adobe, bool_or(latin) AS a, bool_or(latin AND format <> 'eot') AS b, arg_min(url, (NOT loaded, w IS NOT NULL, style = 'italic', abs(coalesce(w, 400) - 400), format <> 'ttf', seq)) FILTER (latin AND format <> 'eot') AS url FROM {_FILES} GROUP BY ALL)")
def w6_f11_font_candidates(df):
    return fonts.candidates(_listed_files(df))


@query(m.FONT_RULES, f"SELECT page_id, seq, row_number() OVER (PARTITION BY page_id ORDER BY CASE WHEN loaded THEN 0 ELSE 2 END + CASE WHEN latin THEN 0 ELSE 1 END, seq) AS place FROM {_FILES}")
def w5_signing_order(df):
    return fonts.signing_order(_listed_files(df)).select("page_id", "seq", "place")


# -- palettes -------------------------------------------------------------------------------------------------------


@query(m.PIXELS, f"SELECT page_id, ((r >> 3) << 10) + ((g >> 3) << 5) + (b >> 3) AS bin, round(count(*) / any_value(t)::DOUBLE, 9) AS share, round(count(*) FILTER (NOT masked) / any_value(op)::DOUBLE, 9) AS open_share, round(any_value(op) / any_value(t)::DOUBLE, 9) AS coverage FROM (SELECT *, count(*) OVER (PARTITION BY page_id) AS t, count(*) FILTER (NOT masked) OVER (PARTITION BY page_id) AS op FROM {o(m.PIXELS)}) GROUP BY page_id, bin")
def a10_pixel_histogram(df):
    return palette.pixel_histogram(df).select("page_id", "bin", *[F.round(x, 9).alias(x) for x in ("share", "open_share", "coverage")])


@query(m.PIXELS, f"SELECT page_id, round(coalesce(avg(near), 0), 9) AS smoothness FROM (SELECT page_id, (greatest(abs(lead(r) OVER w - r), abs(lead(g) OVER w - g), abs(lead(b) OVER w - b)) <= 6)::INT AS near FROM {o(m.PIXELS)} WINDOW w AS (PARTITION BY page_id, y ORDER BY x)) GROUP BY page_id")
def a13_smoothness(df):
    return palette.smoothness(df).withColumn("smoothness", F.round("smoothness", 9))


_CHANNELS = ", ".join(f"('0x' || substr(hex, {2 + 2 * i}, 2))::INTEGER::DOUBLE AS {x}" for i, x in enumerate("rgb"))


@query(r.COLORS, f"""WITH s AS (SELECT page_id, hex, sum(weight) AS share FROM {o(r.COLORS)} GROUP BY ALL), p AS (SELECT *, {_CHANNELS}, row_number() OVER (PARTITION BY page_id ORDER BY share DESC, hex) AS n FROM s),
  q AS (SELECT a.page_id, a.r AS r1, a.g AS g1, a.b AS b1, b.r - a.r AS dr, b.g - a.g AS dg, b.b - a.b AS db, least(a.share, b.share) AS low FROM p a JOIN p b ON a.page_id = b.page_id AND a.n < b.n AND b.n <= 4), t AS (SELECT *, dr * dr + dg * dg + db * db AS d2 FROM q),
  x AS (SELECT p.page_id, p.hex, ((r - r1) * dr + (g - g1) * dg + (b - b1) * db) / d2 AS t, (r - r1) ** 2 + (g - g1) ** 2 + (b - b1) ** 2 AS f2, d2 FROM p JOIN t ON p.page_id = t.page_id AND d2 >= 900 AND share < low)
  SELECT page_id, hex, share FROM s ANTI JOIN (SELECT page_id, hex FROM x WHERE t > 0.06 AND t < 0.94 AND f2 - t * t * d2 < 500) USING (page_id, hex)""")
def a20_without_blends(df):
    return palette.without_blends(df.groupBy("page_id", "hex").agg(F.sum("weight").alias("share")))


@query(r.COLORS)
def e2_palettes(df):
    return palette.build_palettes(df)

