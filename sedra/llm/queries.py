"""Queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import decontaminate, html_text, language, mixing, pii, quality, simhash, token_counts, toxicity, urls
from .common import crc32_mod, cut, table


def op1_token_counts(spark, sf_dir):
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


def op2_html_text(spark, sf_dir):
    return html_text.extract(table(spark, sf_dir, "pages"))


def op4_toxicity(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.where(crc32_mod("doc_id", 5) != 0))
    scored = toxicity.score(docs, model)
    held_out = F.coalesce(crc32_mod("doc_id", 5) == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "clause_weight", "n_clauses", "threat")


def op8_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = language.fit(docs.where(crc32_mod("doc_id", 4) != 2))
    held_out = F.coalesce(crc32_mod("doc_id", 4) == 2, F.lit(False))
    return language.predict(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op3_pii(spark, sf_dir):
    return pii.pseudonymised(table(spark, sf_dir, "documents"))


def op7_decontaminate(spark, sf_dir):
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_simhash(spark, sf_dir):
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return found.select("doc_id", hexed.alias("fingerprint"), "component_id", "n_component")


def op6_quality(spark, sf_dir):
    return quality.quality_verdicts(table(spark, sf_dir, "documents"))


def op9_url_filters(spark, sf_dir):
    return urls.judge_urls(table(spark, sf_dir, "pages"))


OP9_SQL = r"""
WITH rules(h, p, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
rest AS (
  SELECT row_number() OVER () AS n, page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages
),
parts AS (
  SELECT n, page_id, translate(regexp_extract(r, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest
),
fits AS (
  SELECT n, h || p AS rule, v, row_number() OVER (PARTITION BY n ORDER BY length(h || p) DESC, length(h) DESC) AS k
  FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM parts LEFT JOIN (SELECT * FROM fits WHERE k = 1) USING (n)
"""


def op10_mixing(spark, sf_dir):
    return mixing.mixed(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def mixing_targets(spark, sf_dir):
    """What op10_mixing aims at, before any draw: sizes and targets, which SQL can say."""
    sized = cut(mixing.sizes(table(spark, sf_dir, "documents")))
    targets = mixing.source_targets(sized).select(F.col("source").alias("of"), "source_size", F.round("target", 6).alias("target"))
    return sized.join(F.broadcast(targets) if targets.count() <= mixing.MAX_BROADCAST else targets, F.col("source").eqNullSafe(F.col("of"))).select(F.col("id").alias("doc_id"), "size", "source_size", "target")


TARGETS_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
per AS (SELECT source, sum(size) AS source_size, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS rank FROM d GROUP BY source),
w AS (SELECT *, [1.0::DOUBLE, 2.0, 3.0][CAST(rank % 3 + 1 AS BIGINT)] AS w, 3.0::DOUBLE * source_size AS cap FROM per),
o AS (SELECT *, row_number() OVER (ORDER BY cap / w, rank) AS k FROM w),
b AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS caps, sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest, sum(source_size) OVER () AS total FROM o),
l AS (SELECT *, (total - caps) / rest AS level FROM b),
free AS (SELECT min_by(level, k) AS level FROM l WHERE level * w <= cap)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(source_size AS BIGINT) AS source_size, round(CASE WHEN l.level * w > cap OR free.level IS NULL THEN cap ELSE free.level * w END, 6) AS target FROM d JOIN l ON d.source IS NOT DISTINCT FROM l.source, free
"""


_ENDS = ", ".join("'" + c.replace("'", "''") + "'" for c in quality.TERMINAL)
_WS = r"[\x20\x09-\x0D]"
OP6_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT n, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d),
each_ AS (SELECT n, unnest(ws) AS a, generate_subscripts(ws, 1) AS i FROM w),
three AS (SELECT n, i, a, lead(a, 1) OVER o AS b, lead(a, 2) OVER o AS c FROM each_ WINDOW o AS (PARTITION BY n ORDER BY i)),
twice AS (SELECT n, i FROM (SELECT n, i, count(*) OVER (PARTITION BY n, a, b, c) AS k FROM three WHERE c IS NOT NULL) WHERE k > 1),
repeated AS (SELECT n, count(*) AS n_repeat_words FROM (SELECT DISTINCT n, i + o AS at FROM twice, (VALUES (0), (1), (2)) t(o)) GROUP BY n),
lines AS (SELECT n, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM w),
counted AS (SELECT n, i, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS nw, length(regexp_replace(line, '[^\p{{L}}]', '', 'g')) AS letters, length(regexp_replace(line, '[^\p{{Lu}}]', '', 'g')) AS capitals,
  length(regexp_replace(line, '[^#*$%&|<>]', '', 'g')) AS symbols, right(regexp_replace(line, '{_WS}+$', ''), 1) AS last_char FROM lines),
judged AS (SELECT n, nw, row_number() OVER (PARTITION BY n, line ORDER BY i) > 1 AS dup,
  symbols > 0.3::DOUBLE * nw OR (letters >= 12 AND capitals > 0.6::DOUBLE * letters) OR (nw <= 4 AND last_char NOT IN ({_ENDS})) OR (nw <= 40 AND regexp_matches(line, '(?i){quality.BOILERPLATE.pattern}')) AS fails
  FROM counted WHERE nw > 0),
by_doc AS (SELECT n, count(*) FILTER (WHERE dup) AS n_dup_lines, coalesce(sum(nw) FILTER (WHERE fails), 0) AS lost FROM judged GROUP BY n),
base AS (SELECT n, doc_id, len(ws) AS n_words, length(text) - length(regexp_replace(text, '[^\x20\x09-\x0D]', '', 'g')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
  coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(lost, 0) AS lost FROM w LEFT JOIN by_doc USING (n) LEFT JOIN repeated USING (n))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND lost <= 0.4::DOUBLE * n_words AS kept, CAST(lost AS BIGINT) AS n_lost_words FROM base
"""


QUERIES = {"op1_token_counts": op1_token_counts, "op2_html_text": op2_html_text, "op4_toxicity": op4_toxicity, "op8_language": op8_language, "op3_pii": op3_pii, "op7_decontaminate": op7_decontaminate, "op5_simhash": op5_simhash, "op6_quality": op6_quality, "op9_url_filters": op9_url_filters, "op10_mixing": op10_mixing, "mixing_targets": mixing_targets}
ORACLES: dict[str, str] = {"op6_quality": OP6_SQL, "op9_url_filters": OP9_SQL, "mixing_targets": TARGETS_SQL}
