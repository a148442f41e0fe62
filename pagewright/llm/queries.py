"""The operators' queries over the standard tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontam, html, linededup, lm, mixing, neardup, quality, rules, tokens, warc

END_ID = 2


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), percent=80)


def op2_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_output(_table(spark, sf_dir, "documents"), tokenizer_path(), END_ID)


def op5_recurrent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(_table(spark, sf_dir, "documents"))


def op6_isolation_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judged(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_bottom_k_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"), percent=85)


def op8_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_text(_table(spark, sf_dir, "pages"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op10_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.deduplicated_lines(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_decontaminate, op2_importance_resampling, op3_pareto_mix, op4_token_ids, op5_recurrent_lm, op6_isolation_rules, op7_bottom_k_dedup, op8_style_tree, op9_warc, op10_line_templates)}


_WORDS = r"regexp_extract_all(coalesce({}, ''), '[^\x20\x09-\x0D]+')"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _shingles(table: str, key: str) -> str:
    words = _WORDS.format(_LOWER.format("text"))
    return f"""(SELECT {key}, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s
      FROM (SELECT {key}, {words} AS w FROM {table}))"""


DECONTAMINATION_SQL = f"""
WITH d AS {_shingles("documents", "doc_id")}, b AS {_shingles("benchmark", "item_id")},
  x AS (SELECT doc_id, unnest(s) AS g FROM d), y AS (SELECT item_id, len(s) AS n_item, unnest(s) AS g FROM b)
SELECT doc_id, item_id, n_item::BIGINT AS n_item, count(*)::BIGINT AS n_common
FROM x JOIN y USING (g) GROUP BY doc_id, item_id, n_item HAVING 100 * count(*) >= 80 * n_item
"""

MIX_SQL = rf"""
WITH d AS (SELECT doc_id, source, len({_WORDS.format("text")})::BIGINT AS size FROM documents),
  s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
  r AS (SELECT source, source_size, [5, 2, 1][(row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1]::BIGINT AS w FROM s),
  c AS (SELECT *, source_size * 3 * rest_w <= open * w AS capped FROM (
    SELECT *, (sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER (ORDER BY source_size::DOUBLE * 3 / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS open,
      (sum(w) OVER (ORDER BY source_size::DOUBLE * 3 / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS rest_w FROM r)),
  l AS (SELECT arg_max(open, rest_w) AS o, max(rest_w) AS rw FROM c WHERE NOT capped),
  t AS (SELECT source, source_size, CASE WHEN capped THEN (source_size * 3)::DOUBLE ELSE (o * w)::DOUBLE / rw END AS target FROM c, l),
  g AS (SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 3) ELSE 0 END::BIGINT AS copies FROM t),
  n AS (SELECT *, greatest(target - copies * source_size, 0) AS need FROM g),
  b AS (SELECT source, length(bin(size)) AS cls, greatest(17 - length(bin(size)), 1) AS h, sum(size)::BIGINT AS words FROM d WHERE size > 0 GROUP BY ALL),
  e AS (SELECT b.*, need - coalesce(sum(words) OVER (PARTITION BY b.source ORDER BY cls ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS open,
    (sum(words * h) OVER (PARTITION BY b.source ORDER BY cls ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS rest FROM b JOIN n ON b.source IS NOT DISTINCT FROM n.source),
  i AS (SELECT source, cls, CASE WHEN open * h >= rest THEN 1 ELSE (arg_min(open / rest, cls) FILTER (open * h < rest) OVER (PARTITION BY source)) * h END AS p FROM e),
  u AS (SELECT doc_id, source, size, (('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::UBIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u FROM d),
  q AS (SELECT u.doc_id, u.size, n.*, CASE WHEN p >= 1 THEN 0 WHEN p > 0 THEN (u / (1 - u)) / (p / (1 - p)) END AS q FROM u JOIN n ON u.source IS NOT DISTINCT FROM n.source
    LEFT JOIN i ON u.source IS NOT DISTINCT FROM i.source AND length(bin(u.size)) = i.cls),
  o AS (SELECT source, q, sum(size) OVER (PARTITION BY source ORDER BY q) AS upto, sum(size) OVER (PARTITION BY source, q) AS words, need FROM q WHERE q IS NOT NULL),
  k AS (SELECT source, min(q) AS cut, arg_min(upto - need <= need - (upto - words), q) AS with_cut FROM o WHERE upto >= need GROUP BY source)
SELECT doc_id, size, source_size, target,
  (size * CASE WHEN size > 0 THEN copies + coalesce(CASE WHEN with_cut THEN q <= cut ELSE q < cut END, false)::BIGINT ELSE 0 END)::BIGINT AS taken
FROM q LEFT JOIN k ON q.source IS NOT DISTINCT FROM k.source
"""

DEDUP_SQL = f"""
WITH RECURSIVE d AS {_shingles("documents", "doc_id")},
  u AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM d),
  p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM u a JOIN u b ON a.g = b.g AND a.doc_id < b.doc_id
    GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
  e AS (SELECT a, b FROM p UNION SELECT b, a FROM p),
  r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
  c AS (SELECT a AS doc_id, min(b) AS low FROM r GROUP BY a)
SELECT d.doc_id, len(s)::BIGINT AS n_shingles, least(d.doc_id, coalesce(low, d.doc_id)) AS component_id, d.doc_id <= coalesce(low, d.doc_id) AS kept
FROM d LEFT JOIN c ON c.doc_id = d.doc_id
"""

WARC_SQL = """
WITH r AS (SELECT page_id, coalesce(html, '') AS h, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
  f AS (SELECT payload_digest, max(page_id) AS first FROM r WHERE payload_bytes >= 1000 GROUP BY payload_digest HAVING count(*) > 1)
SELECT page_id, payload_bytes, r.payload_digest, CASE WHEN page_id <> first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM r LEFT JOIN f USING (payload_digest)
"""

LINES_SQL = rf"""
WITH t AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
  l AS (SELECT doc_id, unnest(range(1, len(ls) + 1)) AS i, unnest(ls) AS line FROM t),
  k AS (SELECT doc_id, i, {_WORDS.format("line")} AS w FROM l),
  f AS (SELECT doc_id, i, w, len(w) || ' ' || array_to_string(list_transform(w[1:3], lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END), ' ') AS leaf FROM k WHERE len(w) > 0),
  v AS (SELECT leaf FROM f GROUP BY leaf HAVING count(DISTINCT doc_id) >= 10),
  h AS (SELECT f.*, array_to_string(w, ' ') AS content FROM f SEMI JOIN v USING (leaf)),
  p AS (SELECT doc_id, i, leaf, unnest(range(1, len(w) + 1)) AS pos, unnest(w) AS token FROM h),
  x AS (SELECT leaf, pos, token FROM p GROUP BY leaf, pos, token HAVING count(DISTINCT doc_id) >= 10),
  m AS (SELECT p.doc_id, p.i, p.leaf, pos, CASE WHEN x.token IS NOT NULL AND NOT regexp_matches(p.token, '[0-9]') THEN p.token ELSE '<*>' END AS token
    FROM p LEFT JOIN x USING (leaf, pos, token)),
  s AS (SELECT doc_id, i, leaf, string_agg(token, ' ' ORDER BY pos) AS template FROM m GROUP BY doc_id, i, leaf HAVING 100 * count(*) FILTER (token <> '<*>') >= 60 * count(*)),
  z AS (SELECT leaf, template FROM s GROUP BY leaf, template HAVING count(DISTINCT doc_id) >= 10),
  e AS (SELECT doc_id, i, array_to_string(w, ' ') AS content FROM k WHERE len(w) > 50),
  o AS (SELECT content, min(doc_id) AS first FROM e GROUP BY content HAVING count(DISTINCT doc_id) > 1),
  g AS (SELECT doc_id, list(DISTINCT i) AS drops FROM (SELECT doc_id, i FROM s SEMI JOIN z USING (leaf, template) UNION ALL SELECT doc_id, i FROM e JOIN o USING (content) WHERE doc_id > first) GROUP BY doc_id)
SELECT t.doc_id, CASE WHEN drops IS NULL THEN text ELSE array_to_string(list_transform(list_filter(range(1, len(ls) + 1), lambda i: NOT list_contains(drops, i)), lambda i: ls[i]), chr(10)) END AS text,
  coalesce(len(ls), 0)::BIGINT AS n_lines, coalesce(len(drops), 0)::BIGINT AS n_dropped
FROM t LEFT JOIN g USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_decontaminate": DECONTAMINATION_SQL, "op3_pareto_mix": MIX_SQL, "op7_bottom_k_dedup": DEDUP_SQL, "op9_warc": WARC_SQL, "op10_line_templates": LINES_SQL}
