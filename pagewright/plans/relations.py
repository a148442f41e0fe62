"""Input relations derived from the standard tables, in SQL that Spark and DuckDB both run; {t} is table t."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

ASSETS = """
SELECT p_partkey % 25 AS page_id, p_partkey AS ord, sha1(concat('asset:', CAST(p_partkey AS STRING))) AS id,
  CASE WHEN p_partkey % 4 = 0 THEN 'svg' ELSE 'image' END AS kind,
  CASE p_size % 8 WHEN 0 THEN 'site-logo' WHEN 1 THEN 'logo' WHEN 2 THEN 'favicon' WHEN 3 THEN 'social' WHEN 4 THEN 'icon' WHEN 5 THEN 'sprite-symbol' WHEN 6 THEN 'illustration' ELSE 'image' END AS role,
  CASE WHEN p_partkey % 4 = 0 THEN 'svg' WHEN p_partkey % 4 = 1 THEN 'png' WHEN p_partkey % 4 = 2 THEN 'jpg' ELSE 'webp' END AS format,
  concat('Hero_', CAST(p_partkey % 301 AS STRING), CASE WHEN p_partkey % 5 = 0 THEN '_large' WHEN p_partkey % 5 = 1 THEN '@2x' ELSE '' END, '.png') AS name,
  concat('hero-', CAST(p_partkey AS STRING), '.png') AS filename,
  CASE WHEN p_partkey % 97 = 0 THEN NULL ELSE concat('https://cdn', CAST(p_partkey % 3 AS STRING), '.example.com/files/pic', CAST(p_partkey % 777 AS STRING), '.png') END AS url,
  p_partkey % 3 <> 0 AS visible, p_partkey % 11 = 0 AS declared_only,
  CAST(p_size * 37 % 1900 AS DOUBLE) AS width, CAST(p_size * 53 % 1300 AS DOUBLE) AS height,
  CAST(p_size * 7 % 400 AS DOUBLE) AS rendered_w, CAST(p_size * 11 % 300 AS DOUBLE) AS rendered_h,
  CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE CAST(floor(p_retailprice * 900) AS BIGINT) END AS bytes,
  CASE WHEN p_partkey % 7 = 0 THEN sha1(concat('c', CAST(p_partkey % 50 AS STRING))) ELSE sha1(CAST(p_partkey AS STRING)) END AS sha1,
  CASE p_size % 8 WHEN 0 THEN 1000.0E0 WHEN 1 THEN 500.0E0 WHEN 2 THEN 300.0E0 WHEN 3 THEN 200.0E0 ELSE 100.0E0 END - CAST(p_partkey % 1000 AS DOUBLE) / 100 AS score
FROM {part}
"""
CANDIDATES = """
SELECT l_suppkey AS page_id, concat('https://cdn.example.com/img/', CAST(l_partkey % 40 AS STRING), '.png') AS url, l_orderkey * 8 + l_linenumber AS ord,
  CASE l_linenumber % 4 WHEN 0 THEN 'img-src' WHEN 1 THEN 'srcset' WHEN 2 THEN 'css' ELSE 'og-image' END AS found_in, l_orderkey AS grp,
  l_quantity > 25 AS visible, l_linenumber % 4 = 2 AS declared_only, CAST(l_quantity * 10 AS DOUBLE) AS descriptor_w,
  CAST(l_partkey % 90 * 10 AS DOUBLE) AS natural_w, CAST(l_linenumber * 100 AS DOUBLE) AS natural_h,
  CASE WHEN l_orderkey % 3 = 0 THEN concat('label ', CAST(l_orderkey % 100 AS STRING)) END AS label, l_linenumber % 7 AS logo_score
FROM {lineitem}
"""
CAPTURES = """
SELECT DISTINCT l_suppkey AS page_id, concat('https://cdn.example.com/img/', CAST(l_partkey % 55 AS STRING), '.png') AS url,
  CAST(CASE WHEN l_partkey % 55 % 6 = 0 THEN 404 ELSE 200 END AS INT) AS status, CAST(l_partkey % 55 * 1000 AS BIGINT) AS bytes
FROM {lineitem} WHERE l_partkey % 55 % 4 <> 1
"""
URLS = """
SELECT p_partkey AS id, p_partkey % 10 AS page_id,
  CASE p_partkey % 21 WHEN 16 THEN concat('https://shop.example/a.png?next=/track/', CAST(p_size AS STRING)) WHEN 17 THEN 'data:image/svg+xml,%3Csvg/%3E' WHEN 18 THEN concat('https://shop.example/b.png?w=', CAST(p_size AS STRING))
    WHEN 19 THEN 'HTTPS://Pic.Example.com:8443/x/y.gif?v=2#frag' WHEN 20 THEN 'https://trk.example/collect/' WHEN 0 THEN concat('https://www.google-analytics.com/collect?v=', CAST(p_size AS STRING)) WHEN 1 THEN 'https://s.pinimg.com/ct/lib/main.png'
    WHEN 2 THEN concat('https://shop.example/track/hero', CAST(p_size AS STRING), '.png') WHEN 3 THEN 'https://a.example.org/i/spacer.gif' WHEN 4 THEN 'ftp://x.example/a.png'
    WHEN 5 THEN 'https://cdn.cookielaw.org/logo.svg' WHEN 6 THEN 'https://static.intercomcdn.com/a.png' WHEN 7 THEN 'data:image/png;base64,AAAA'
    WHEN 8 THEN 'https://i.pinimg.com/736x/ab/cd/photo.jpg' WHEN 9 THEN 'https://News.BBC.co.uk/Pic.JPEG?x=1' WHEN 10 THEN 'https://www.example.com/a/b.AVIF#top' WHEN 11 THEN 'blob:https://x/1'
    ELSE concat('https://img', CAST(p_size AS STRING), '.example.net/p/', CAST(p_partkey AS STRING), '.webp') END AS url,
  CASE WHEN p_partkey % 17 = 0 THEN 'text/html; charset=utf-8' WHEN p_partkey % 13 = 0 THEN 'application/x-binary' WHEN p_partkey % 5 = 0 THEN 'Image/jpeg' END AS content_type,
  CASE WHEN p_partkey % 4 = 0 THEN '<svg><g/></svg>' WHEN p_partkey % 4 = 1 THEN '<svg><path d="M0 0"/></svg>' WHEN p_partkey % 4 = 2 THEN '<svg><filter><feGaussianBlur/></filter><image href="x"/></svg>' END AS svg_text,
  CAST(CASE WHEN p_partkey % 19 = 0 THEN 2 ELSE p_size END AS DOUBLE) AS width, CAST(CASE WHEN p_partkey % 19 = 0 THEN 1 ELSE p_size * 3 END AS DOUBLE) AS height
FROM {part}
"""
COLORS = """
SELECT o_custkey % 30 AS page_id, CASE o_orderkey % 5 WHEN 0 THEN 'cta' WHEN 1 THEN 'bg' WHEN 2 THEN 'text' WHEN 3 THEN 'link' ELSE 'logo' END AS source,
  printf('#%06x', o_orderkey * 2654435761 % 16777216) AS hex, CAST(floor(o_totalprice) AS DOUBLE) AS weight, o_orderkey % 7 + 1 AS n
FROM {orders}
"""
REQUESTS = "SELECT event_id AS request_id, ts, user_id AS client, CAST(floor(value * 100) AS BIGINT) AS bytes, event_type AS type FROM {events}"
MEMBERS = """
SELECT page_id, n * 20 + page_id AS idx, kind, grp1, grp2, preferred_group, art_directed,
  CASE WHEN page_id = 7 THEN concat('chain', CAST(CAST(floor(n / 2) AS BIGINT) AS STRING)) ELSE variant_key END AS variant_key,
  CASE WHEN page_id = 7 THEN concat('link', CAST(CAST(floor((n + 1) / 2) AS BIGINT) AS STRING)) ELSE sha1 END AS sha1, size_score
FROM (SELECT p_partkey % 20 AS page_id, CAST(floor(p_partkey / 20) AS BIGINT) AS n, CASE WHEN p_partkey % 4 = 0 THEN 'svg' ELSE 'image' END AS kind,
  CASE WHEN p_partkey % 3 = 0 THEN p_partkey * 7 % 1009 % 90 END AS grp1, CASE WHEN p_partkey % 6 = 0 THEN p_partkey * 11 % 1009 % 90 END AS grp2,
  CASE WHEN p_partkey % 12 = 0 THEN p_partkey * 11 % 1009 % 90 END AS preferred_group, p_partkey % 15 = 0 AS art_directed, concat('k', CAST(p_partkey * 31 % 997 AS STRING)) AS variant_key,
  CASE WHEN p_partkey % 5 = 0 THEN concat('h', CAST(p_partkey * 13 % 499 AS STRING)) END AS sha1, CAST(p_size * p_partkey % 1000 AS DOUBLE) AS size_score
  FROM {part})
"""


def spark_relation(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in set(re.findall(r"\{(\w+)\}", sql))}
    return spark.sql(sql, **tables)


def oracle_relation(sql: str) -> str:
    return "(" + re.sub(r"\{(\w+)\}", r"\1", sql) + ")"
