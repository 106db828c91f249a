"""Queries over the library's operators, and the same in SQL where SQL can say them.

Each takes (spark, sf_dir) and reads whole tables, but for rules of Vietnamese law: no table fits them, and
they run on the few rows of `samples` and do not grow with the tables; only the chunker has a query over documents too.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from . import samples as S
from .functions.text import PUNCTUATION, tokens
from .operators import bm25, chunk, cite, contain, dense, evaluate, filters, fusion, ids, mine, query, rerank, tables, tag
from .plans import pipeline
from .plans.stages import few, staged

K, POOL = 10, 20


def table(spark, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs_of(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def questions_of(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


# --- SQL fragments ---------------------------------------------------------------------------------------

_P = PUNCTUATION.replace("'", "''")
TOKENS_SQL = (
    "list_filter(string_split(trim(regexp_replace(translate(lower(replace(coalesce(text, ''), chr(160), ' ')), "
    f"'{_P}', '{' ' * len(PUNCTUATION)}'), '\\s+', ' ', 'g')), ' '), lambda t: t <> '')"
)
CORPUS_SQL = f"""
parsed AS MATERIALIZED (SELECT doc_id AS doc, {TOKENS_SQL} AS terms FROM documents),
tf AS MATERIALIZED (SELECT doc, term, count(*) AS tf FROM (SELECT doc, unnest(terms) AS term FROM parsed) GROUP BY ALL),
dl AS (SELECT doc, len(terms) AS dl FROM parsed),
stats AS (SELECT count(*)::DOUBLE AS n, avg(dl) AS avgdl FROM dl),
dfs AS (SELECT term, count(*)::DOUBLE AS df FROM tf GROUP BY term),
asked AS (SELECT item_id AS query, term, count(*) AS qf FROM (SELECT item_id, unnest({TOKENS_SQL}) AS term FROM benchmark) GROUP BY ALL)
"""
IDF_SQL = {
    "okapi": "raw AS MATERIALIZED (SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS r FROM dfs, stats), mean AS MATERIALIZED (SELECT avg(r) AS mean FROM raw), idf AS MATERIALIZED (SELECT term, df, CASE WHEN r < 0 THEN 0.25 * mean ELSE r END AS idf FROM raw, mean)",
    "plus": "idf AS (SELECT term, df, ln((n + 1.0) / df) AS idf FROM dfs, stats)",
    "l": "idf AS (SELECT term, df, ln(n + 1.0) - ln(df + 0.5) AS idf FROM dfs, stats)",
}
PART_SQL = {
    "okapi": ("tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))", "0.0"),
    "plus": ("1.0 + tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))", "1.0"),
    "l": ("2.5 * (tf / (0.25 + 0.75 * dl / avgdl) + 0.5) / (1.5 + tf / (0.25 + 0.75 * dl / avgdl) + 0.5)", "2.5 * 0.5 / 2.0"),
}


def bm25_sql(variant: str = "okapi", k: int = K, where: str = "true") -> str:
    """CTEs up to hits (query, doc, rank, score)."""
    part, absent = PART_SQL[variant]
    return f"""{CORPUS_SQL}, {IDF_SQL[variant]},
base AS (SELECT query, sum(qf * idf * ({absent})) AS base FROM asked JOIN idf USING (term) GROUP BY query),
sums AS (
  SELECT query, doc, sum(qf * idf * (({part}) - ({absent}))) AS gain FROM tf JOIN asked USING (term) JOIN idf USING (term) JOIN dl USING (doc), stats
  WHERE doc IN (SELECT doc_id FROM documents WHERE {where}) GROUP BY query, doc
),
scored AS (SELECT query, doc, round(gain + base, 6) + 0.0 AS score FROM sums JOIN base USING (query)),
hits AS (SELECT * FROM (SELECT query, doc, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS INTEGER) AS rank, score FROM scored) WHERE rank <= {k})
"""


def knn_sql(metric: str = "cosine", k: int = K, where: str = "true") -> str:
    """CTEs up to near (query, doc, rank, score): every 20th vector against all."""
    score = {
        "cosine": "list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[])",
        "ip": "list_inner_product(v.embedding::DOUBLE[], q.embedding::DOUBLE[])",
        "l2": "-list_distance(v.embedding::DOUBLE[], q.embedding::DOUBLE[])",
    }[metric]
    return f"""pairs AS (SELECT q.vec_id AS query, v.vec_id AS doc, round({score}, 6) + 0.0 AS score FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0 AND {where}),
near AS (SELECT * FROM (SELECT query, doc, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS INTEGER) AS rank, score FROM pairs) WHERE rank <= {k})
"""


QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


# --- lexical ---------------------------------------------------------------------------------------------


@register("tokenize_tf", f"WITH {CORPUS_SQL} SELECT doc, term, tf FROM tf")
def tokenize_tf(spark, sf_dir):
    return bm25.term_frequencies(bm25.tokenised(docs_of(spark, sf_dir), "doc_id", "text"))


@register("bm25_idf", f"WITH {CORPUS_SQL}, {IDF_SQL['okapi']} SELECT term, CAST(df AS BIGINT) AS df, round(idf, 6) + 0.0 AS idf FROM idf")
def bm25_idf(spark, sf_dir):
    return bm25.build_index(docs_of(spark, sf_dir)).idf.select("term", "df", (F.round("idf", 6) + F.lit(0.0)).alias("idf"))


def _hits(spark, sf_dir, variant="okapi", k=K, keep=None):
    return bm25.search_text(docs_of(spark, sf_dir), questions_of(spark, sf_dir), k, bm25.Bm25(variant), keep=keep)


@register("bm25_topk", f"WITH {bm25_sql()} SELECT * FROM hits")
def bm25_topk(spark, sf_dir):
    return _hits(spark, sf_dir)


@register("bm25_plus_topk", f"WITH {bm25_sql('plus')} SELECT * FROM hits")
def bm25_plus_topk(spark, sf_dir):
    return _hits(spark, sf_dir, "plus")


@register("bm25_l_topk", f"WITH {bm25_sql('l')} SELECT * FROM hits")
def bm25_l_topk(spark, sf_dir):
    return _hits(spark, sf_dir, "l")


@register("bm25_filtered", f"WITH {bm25_sql(where="lang IN ('de', 'fr')")} SELECT * FROM hits")
def bm25_filtered(spark, sf_dir):
    docs = docs_of(spark, sf_dir)
    return _hits(spark, sf_dir, keep=filters.condition(docs, {"lang": ["de", "fr"]}))


PADDED_SQL = f"""WITH {bm25_sql(k=1000000)},
short AS (SELECT a.query FROM (SELECT DISTINCT query FROM asked) a LEFT JOIN (SELECT query, count(*) AS m FROM scored GROUP BY query) s USING (query) WHERE coalesce(m, 0) < {K}),
others AS (SELECT s.query, d.doc_id AS doc, coalesce(b.base, 0.0) + 0.0 AS score FROM short s CROSS JOIN documents d LEFT JOIN base b USING (query) WHERE NOT EXISTS (SELECT 1 FROM scored c WHERE c.query = s.query AND c.doc = d.doc_id)),
every AS (SELECT query, doc, score FROM scored UNION ALL SELECT query, doc, score FROM others)
SELECT * FROM (SELECT query, doc, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS INTEGER) AS rank, score FROM every) WHERE rank <= {K}"""


@register("bm25_padded", PADDED_SQL)
def bm25_padded(spark, sf_dir):
    index = bm25.build_index(docs_of(spark, sf_dir))
    return bm25.search(index, questions_of(spark, sf_dir), K)


# --- filters ---------------------------------------------------------------------------------------------

_TERMS = f"(SELECT doc_id, lang, source, {TOKENS_SQL} AS terms FROM documents)"


def _with_terms(spark, sf_dir):
    return docs_of(spark, sf_dir).select("doc_id", "lang", "source", tokens(F.col("text")).alias("terms"))


@register("filter_scalar", "SELECT doc_id, lang, source FROM documents WHERE lang = 'en' AND source = 'src3'")
def filter_scalar(spark, sf_dir):
    return filters.apply(docs_of(spark, sf_dir), {"lang": "en", "source": "src3"}).select("doc_id", "lang", "source")


@register("filter_in", "SELECT doc_id, lang, source FROM documents WHERE lang IN ('de', 'es') AND source IN ('src0', 'src1', 'src2')")
def filter_in(spark, sf_dir):
    return filters.apply(docs_of(spark, sf_dir), {"lang": ["de", "es"], "source": ["src0", "src1", "src2"]}).select("doc_id", "lang", "source")


@register("filter_array_overlap", f"SELECT doc_id FROM {_TERMS} WHERE list_has_any(terms, ['und', 'avec']) AND list_contains(terms, 'la')")
def filter_array_overlap(spark, sf_dir):
    df = _with_terms(spark, sf_dir)
    return filters.apply(filters.apply(df, {"terms": ["und", "avec"]}), {"terms": "la"}).select("doc_id")


@register("filter_missing", "SELECT d.doc_id FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.toxic = 1")
def filter_missing(spark, sf_dir):
    """Sparse metadata: a document without a label passes no clause on it."""
    df = docs_of(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return filters.apply(df, {"toxic": 1}).select("doc_id")


@register("flatten_flags", f"SELECT doc_id, lang, source, list_contains(terms, 'the') AS w_the, list_contains(terms, 'der') AS w_der FROM {_TERMS}")
def flatten_flags(spark, sf_dir):
    return filters.flatten_flags(_with_terms(spark, sf_dir), {"terms": ("w_", ["the", "der"])})


# --- dense -----------------------------------------------------------------------------------------------


def _near(spark, sf_dir, metric="cosine", k=K, keep=None):
    vectors = table(spark, sf_dir, "embeddings")
    asked = vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query"), "embedding")
    return dense.knn(vectors, asked, k, metric, keep=keep).withColumnRenamed("id", "doc")


@register("knn_cosine", f"WITH {knn_sql()} SELECT * FROM near")
def knn_cosine(spark, sf_dir):
    return _near(spark, sf_dir)


@register("knn_ip", f"WITH {knn_sql('ip')} SELECT * FROM near")
def knn_ip(spark, sf_dir):
    return _near(spark, sf_dir, "ip")


@register("knn_l2", f"WITH {knn_sql('l2')} SELECT * FROM near")
def knn_l2(spark, sf_dir):
    return _near(spark, sf_dir, "l2")


@register("knn_filtered", f"WITH {knn_sql(where='v.label IN (1, 2, 3)')} SELECT * FROM near")
def knn_filtered(spark, sf_dir):
    return _near(spark, sf_dir, keep=filters.condition(table(spark, sf_dir, "embeddings"), {"label": [1, 2, 3]}))


@register("vector_upsert", "SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN -1 ELSE label END AS label FROM embeddings UNION ALL SELECT vec_id + 1000000, label FROM embeddings WHERE vec_id % 5 = 0")
def vector_upsert(spark, sf_dir):
    have = table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("int").alias("label"))
    changed = have.where("vec_id % 7 = 0").withColumn("label", F.lit(-1))
    fresh = have.where("vec_id % 5 = 0").withColumn("vec_id", F.col("vec_id") + 1000000)
    return dense.upsert(have, changed.unionByName(fresh))


# --- fusion: okapi and plus stand for the two arms -------------------------------------------------------


def _two_arms(spark, sf_dir):
    return bm25.search_runs(docs_of(spark, sf_dir), questions_of(spark, sf_dir), [(POOL, bm25.Bm25("okapi")), (POOL, bm25.Bm25("l"))])


_ARMS = f"""{bm25_sql(k=POOL)}, first AS (SELECT * FROM hits), {IDF_SQL['l'].replace('idf AS', 'idf2 AS', 1)},
base2 AS (SELECT query, sum(qf * idf * ({PART_SQL['l'][1]})) AS base FROM asked JOIN idf2 USING (term) GROUP BY query),
sums2 AS (SELECT query, doc, sum(qf * idf * (({PART_SQL['l'][0]}) - ({PART_SQL['l'][1]}))) AS gain FROM tf JOIN asked USING (term) JOIN idf2 USING (term) JOIN dl USING (doc), stats GROUP BY query, doc),
scored2 AS (SELECT query, doc, round(gain + base, 6) + 0.0 AS score FROM sums2 JOIN base2 USING (query)),
second AS (SELECT * FROM (SELECT query, doc, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS INTEGER) AS rank, score FROM scored2) WHERE rank <= {POOL}),
lists AS (SELECT query, doc, rank, 0 AS list_id FROM first UNION ALL SELECT query, doc, rank, 1 FROM second)
"""


def _rrf_sql(w0: str = "1.0", w1: str = "1.0") -> str:
    return f"""fused AS (
  SELECT query, doc, rrf_score, CAST(row_number() OVER (PARTITION BY query ORDER BY rrf_score DESC, seen) AS INTEGER) AS rank FROM (
    SELECT query, doc, round(sum(CASE list_id WHEN 0 THEN {w0} ELSE {w1} END / (60.0 + rank)), 12) AS rrf_score, min(list_id * 1000 + rank) AS seen FROM lists GROUP BY query, doc))
"""


def _lists(spark, sf_dir):
    a, b = _two_arms(spark, sf_dir)
    return bm25.union_ranked(a.select("query", "doc", "rank"), b.select("query", "doc", "rank"))


@register("rrf_fuse", f"WITH {_ARMS}, {_rrf_sql()} SELECT * FROM fused")
def rrf_fuse(spark, sf_dir):
    return fusion.rrf(_lists(spark, sf_dir))


@register("rrf_weighted", f"WITH {_ARMS}, {_rrf_sql('0.5', '2.0')} SELECT * FROM fused")
def rrf_weighted(spark, sf_dir):
    return fusion.rrf(_lists(spark, sf_dir), weights=[0.5, 2.0], n_lists=2)


@register(
    "rrf_explain",
    f"""WITH {_ARMS} SELECT query, doc, coalesce(min(CASE WHEN list_id = 0 THEN rank END)::DOUBLE, 'Infinity'::DOUBLE) AS a_rank, round(coalesce(sum(CASE WHEN list_id = 0 THEN 1.0::DOUBLE / (60 + rank) END), 0), 12) AS a_contribution,
    coalesce(min(CASE WHEN list_id = 1 THEN rank END)::DOUBLE, 'Infinity'::DOUBLE) AS b_rank, round(coalesce(sum(CASE WHEN list_id = 1 THEN 1.0::DOUBLE / (60 + rank) END), 0), 12) AS b_contribution,
    round(sum(1.0::DOUBLE / (60 + rank)), 12) AS total FROM lists GROUP BY query, doc""",
)
def rrf_explain(spark, sf_dir):
    out = fusion.explain(_lists(spark, sf_dir), ["a", "b"])
    return out.withColumns({c: F.round(c, 12) for c in ("a_contribution", "b_contribution", "total")})


def _hybrid(spark, sf_dir, k=K):
    a, b = _two_arms(spark, sf_dir)
    return fusion.hybrid(a, b, k)


_HYBRID_SQL = f"""{_ARMS}, {_rrf_sql()}, hybrid AS (
  SELECT f.query, f.doc, f.rrf_score, f.rank, a.rank AS bm25_rank, b.rank AS dense_rank, CASE WHEN a.rank IS NOT NULL AND b.rank IS NOT NULL THEN 'both' WHEN a.rank IS NOT NULL THEN 'bm25' ELSE 'dense' END AS retrievers
  FROM fused f LEFT JOIN first a USING (query, doc) LEFT JOIN second b USING (query, doc) WHERE f.rank <= {K})
"""


@register("hybrid_provenance", f"WITH {_HYBRID_SQL} SELECT * FROM hybrid")
def hybrid_provenance(spark, sf_dir):
    return _hybrid(spark, sf_dir)


@register("hybrid_hydrate", f"WITH {_HYBRID_SQL} SELECT h.query, h.doc, h.rank, d.lang, d.source, d.n_chars FROM hybrid h JOIN (SELECT * FROM documents WHERE source <> 'src0') d ON h.doc = d.doc_id")
def hybrid_hydrate(spark, sf_dir):
    chunks = docs_of(spark, sf_dir).where("source <> 'src0'").select(F.col("doc_id").alias("doc"), "lang", "source", "n_chars")
    return fusion.hydrate(_hybrid(spark, sf_dir), chunks, K).select("query", "doc", "rank", "lang", "source", "n_chars")


_MERGE_SQL = f"""WITH {_HYBRID_SQL}, subs AS (SELECT query // 2 AS q, query % 2 AS sub, doc, rank, rrf_score FROM hybrid),
once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q, doc ORDER BY sub, rank) AS n FROM subs) WHERE n = 1)
SELECT q AS query, doc, CAST(sub AS INTEGER) AS sub, rrf_score, CAST(row_number() OVER (PARTITION BY q ORDER BY rrf_score DESC, sub, rank) AS INTEGER) AS rank FROM once"""


@register("multiquery_merge", _MERGE_SQL)
def multiquery_merge(spark, sf_dir):
    """Neighbouring questions as the sub-queries of one."""
    subs = _hybrid(spark, sf_dir).withColumn("sub", (F.col("query") % 2).cast("int")).withColumn("query", F.expr("query div 2"))
    return fusion.merge_subqueries(subs.select("query", "sub", "doc", "rank", "rrf_score"))


# --- metrics ---------------------------------------------------------------------------------------------


def gold_of(spark, sf_dir):
    """(query, doc): documents that contain the benchmark item."""
    return contain.containing(docs_of(spark, sf_dir), table(spark, sf_dir, "benchmark"))


_GOLD = "gold AS (SELECT DISTINCT b.item_id AS query, d.doc_id AS doc FROM documents d JOIN benchmark b ON contains(d.text, b.text))"


def _metrics_sql(run: str, name: str = "each") -> str:
    ks = (1, 3, 5, 10)
    hits = ", ".join(f"sum(CASE WHEN r.rank <= {k} AND g.doc IS NOT NULL THEN 1 ELSE 0 END) AS hits_{k}" for k in ks)
    recall = ", ".join(f"coalesce(hits_{k}, 0)::DOUBLE / n_gold AS recall_{k}" for k in ks)
    precision = ", ".join(f"coalesce(coalesce(hits_{k}, 0)::DOUBLE / nullif(least({k}, coalesce(returned, 0)), 0), 0) AS precision_{k}" for k in ks)
    return f"""{name} AS (SELECT n.query, n_gold, coalesce(1.0::DOUBLE / first, 0) AS rr, {recall}, {precision}
  FROM (SELECT query, count(*) AS n_gold FROM gold GROUP BY query) n LEFT JOIN
    (SELECT r.query, count(*) AS returned, min(CASE WHEN g.doc IS NOT NULL THEN r.rank END) AS first, {hits} FROM {run} r LEFT JOIN gold g ON g.query = r.query AND g.doc = r.doc GROUP BY r.query) h USING (query))"""


def _per_query(spark, sf_dir):
    return evaluate.per_query(_hits(spark, sf_dir), gold_of(spark, sf_dir))


@register("recall_at_k", f"WITH {bm25_sql()}, {_GOLD}, {_metrics_sql('hits')} SELECT query, n_gold, round(recall_1, 9) AS recall_1, round(recall_3, 9) AS recall_3, round(recall_5, 9) AS recall_5, round(recall_10, 9) AS recall_10 FROM each")
def recall_at_k(spark, sf_dir):
    return _per_query(spark, sf_dir).select("query", "n_gold", *[F.round(f"recall_{k}", 9).alias(f"recall_{k}") for k in (1, 3, 5, 10)])


@register("precision_at_k", f"WITH {bm25_sql()}, {_GOLD}, {_metrics_sql('hits')} SELECT query, round(precision_1, 9) AS precision_1, round(precision_3, 9) AS precision_3, round(precision_5, 9) AS precision_5, round(precision_10, 9) AS precision_10 FROM each")
def precision_at_k(spark, sf_dir):
    return _per_query(spark, sf_dir).select("query", *[F.round(f"precision_{k}", 9).alias(f"precision_{k}") for k in (1, 3, 5, 10)])


@register("mrr", f"WITH {bm25_sql()}, {_GOLD}, {_metrics_sql('hits')} SELECT round(avg(rr), 9) AS mrr, count(*) AS n_queries FROM each")
def mrr(spark, sf_dir):
    return _per_query(spark, sf_dir).agg(F.round(F.avg("rr"), 9).alias("mrr"), F.count("*").alias("n_queries"))


def _candidates(spark, sf_dir, k=K, hits=None):
    """Fused hits with their token arrays and the question's: only texts of hits are tokenised."""
    hits = few(_hybrid(spark, sf_dir, k) if hits is None else hits)
    docs = docs_of(spark, sf_dir).select(F.col("doc_id").alias("doc"), "text")
    asked = few(questions_of(spark, sf_dir).select(F.col("query_id").alias("query"), tokens(F.col("text")).alias("asked")))
    return docs.join(hits, "doc").withColumn("terms", tokens(F.col("text"))).drop("text").join(asked, "query")


def _reranked(spark, sf_dir, top_k=3, hits=None):
    return rerank.rerank(_candidates(spark, sf_dir, hits=hits), F.round(rerank.jaccard(F.col("asked"), F.col("terms")), 9), top_k)


_JACCARD = "CASE WHEN len(a.terms) > 0 AND len(p.terms) > 0 THEN len(list_intersect(a.terms, p.terms))::DOUBLE / len(list_distinct(list_concat(a.terms, p.terms))) ELSE 0 END"
_ITEMS = f"items AS (SELECT item_id AS query, {TOKENS_SQL} AS terms FROM benchmark)"
_RERANK_SQL = f"""{_HYBRID_SQL}, {_ITEMS}, reranked AS (SELECT * FROM (
  SELECT query, doc, rrf_score, pre_rerank_rank, cross_encoder_score, CAST(row_number() OVER (PARTITION BY query ORDER BY cross_encoder_score DESC, pre_rerank_rank) AS INTEGER) AS rank FROM (
    SELECT h.query, h.doc, h.rrf_score, h.rank AS pre_rerank_rank, round({_JACCARD}, 9) AS cross_encoder_score FROM hybrid h JOIN items a ON a.query = h.query JOIN parsed p ON p.doc = h.doc)) WHERE rank <= 3)
"""


@register("rerank_lexical", f"WITH {_RERANK_SQL} SELECT query, doc, cross_encoder_score, pre_rerank_rank, rank FROM reranked")
def rerank_lexical(spark, sf_dir):
    return _reranked(spark, sf_dir).select("query", "doc", "cross_encoder_score", "pre_rerank_rank", "rank")


_LIFT_SQL = f"""WITH {_RERANK_SQL}, {_GOLD}, {_metrics_sql('hybrid', 'before_')}, {_metrics_sql('reranked', 'after_')},
m AS (SELECT unnest(['mrr', 'recall', 'recall', 'recall', 'recall', 'precision', 'precision', 'precision', 'precision']) AS metric, unnest([NULL, 1, 3, 5, 10, 1, 3, 5, 10]) AS k,
  unnest((SELECT [avg(rr), avg(recall_1), avg(recall_3), avg(recall_5), avg(recall_10), avg(precision_1), avg(precision_3), avg(precision_5), avg(precision_10)] FROM before_)) AS a,
  unnest((SELECT [avg(rr), avg(recall_1), avg(recall_3), avg(recall_5), avg(recall_10), avg(precision_1), avg(precision_3), avg(precision_5), avg(precision_10)] FROM after_)) AS b)
SELECT metric, CAST(k AS INTEGER) AS k, round(a, 9) AS before, round(b, 9) AS after, round(b - a, 9) + 0.0 AS abs_lift, CASE WHEN a > 0 THEN round(100.0 * (b - a) / a, 6) + 0.0 ELSE 'Infinity'::DOUBLE END AS rel_lift_pct FROM m"""


@register("stage_lift", _LIFT_SQL)
def stage_lift(spark, sf_dir):
    gold, hits = staged(gold_of(spark, sf_dir)), staged(_hybrid(spark, sf_dir))
    out = evaluate.lift(evaluate.stage(hits, gold, "hybrid"), evaluate.stage(_reranked(spark, sf_dir, hits=hits), gold, "rerank"))
    r = lambda c, n: (F.round(c, n) + F.lit(0.0)).alias(c)
    return out.select("metric", "k", r("before", 9), r("after", 9), r("abs_lift", 9), r("rel_lift_pct", 6))


# --- context, mining -------------------------------------------------------------------------------------

_TOPS_SQL = "tops AS (SELECT query // 3 AS q, query % 3 AS intent, doc, rank, cross_encoder_score FROM reranked WHERE rank <= 2)"


@register(
    "intent_merge",
    f"""WITH {_RERANK_SQL}, {_TOPS_SQL},
    f AS (SELECT *, (rank = 1)::INTEGER AS first FROM tops),
    once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q, doc ORDER BY first DESC, CASE WHEN first = 1 THEN intent END NULLS FIRST, cross_encoder_score DESC, intent, rank) AS n FROM f) WHERE n = 1),
    placed AS (SELECT *, CAST(row_number() OVER (PARTITION BY q ORDER BY first DESC, CASE WHEN first = 1 THEN intent END NULLS FIRST, cross_encoder_score DESC, intent, rank) AS INTEGER) AS position FROM once)
    SELECT q AS query, doc, CAST(intent AS INTEGER) AS intent, cross_encoder_score, first = 1 AS guaranteed, position FROM placed WHERE first = 1 OR position <= 5""",
)
def intent_merge(spark, sf_dir):
    """Three neighbouring questions as the intents of one."""
    tops = _reranked(spark, sf_dir, 2).withColumn("intent", (F.col("query") % 3).cast("int")).withColumn("query", F.expr("query div 3"))
    return rerank.merge_intents(tops.select("query", "intent", "doc", "rank", "cross_encoder_score"))


@register(
    "score_gate",
    f"""WITH {_RERANK_SQL} SELECT b.item_id AS query, coalesce(n, 0) AS n_sources, top_score, n IS NULL OR coalesce(top_score < 0.2, false) AS refused
    FROM benchmark b LEFT JOIN (SELECT query, count(*) AS n, max(CASE WHEN rank = 1 THEN cross_encoder_score END) AS top_score FROM reranked GROUP BY query) r ON r.query = b.item_id""",
)
def score_gate(spark, sf_dir):
    return rerank.gate(_reranked(spark, sf_dir), questions_of(spark, sf_dir).select(F.col("query_id").alias("query")), 0.2)


@register(
    "low_confidence_fallback",
    f"""WITH {_RERANK_SQL}, best AS (SELECT query, max(cross_encoder_score) AS best FROM reranked GROUP BY query)
    SELECT query, doc, rank, cross_encoder_score FROM reranked JOIN best USING (query) WHERE best >= 0.2 AND rank <= 2
    UNION ALL SELECT h.query, h.doc, h.rank, h.rrf_score FROM hybrid h JOIN best b ON b.query = h.query WHERE b.best < 0.2 AND h.rank <= 2""",
)
def low_confidence_fallback(spark, sf_dir):
    candidates = staged(_candidates(spark, sf_dir))
    best = rerank.rerank(candidates, F.round(rerank.jaccard(F.col("asked"), F.col("terms")), 9), 3)
    return rerank.low_confidence_fallback(candidates, best, 2, 0.2).select("query", "doc", "rank", "cross_encoder_score")


@register("token_jaccard", f"WITH {_HYBRID_SQL}, {_ITEMS} SELECT h.query, h.doc, round({_JACCARD}, 9) AS jaccard FROM hybrid h JOIN items a ON a.query = h.query JOIN parsed p ON p.doc = h.doc")
def token_jaccard(spark, sf_dir):
    return _candidates(spark, sf_dir).select("query", "doc", F.round(rerank.jaccard(F.col("asked"), F.col("terms")), 9).alias("jaccard"))


@register(
    "ranking_loss",
    f"""WITH {_RERANK_SQL} SELECT query, round(ln(list_sum(list_transform(s, lambda x: exp(20.0 * x - 20.0 * list_max(s))))) + 20.0 * list_max(s) - 20.0 * s[1], 6) + 0.0 AS loss
    FROM (SELECT query, list(cross_encoder_score ORDER BY pre_rerank_rank) AS s FROM reranked GROUP BY query)""",
)
def ranking_loss(spark, sf_dir):
    rows = _reranked(spark, sf_dir).groupBy("query").agg(F.sort_array(F.collect_list(F.struct("pre_rerank_rank", "cross_encoder_score"))).alias("s"))
    return rows.select("query", (F.round(rerank.ranking_loss(F.transform("s", lambda x: x["cross_encoder_score"])), 6) + F.lit(0.0)).alias("loss"))


def _pairs(spark, sf_dir):
    gold = staged(gold_of(spark, sf_dir)).groupBy("query").agg(F.min("doc").alias("positive"), F.sort_array(F.collect_set("doc")).alias("extra"))
    manual = F.array(F.lit(3), F.lit(5)).cast("array<bigint>")
    return gold.select(F.col("query").alias("pair"), "positive", "extra", F.filter(manual, lambda m: (m != F.col("positive")) & (F.col("query") % 2 == 0)).alias("manual"))


_MINE_SQL = f"""WITH {bm25_sql(k=POOL)}, {_GOLD},
pairs AS (SELECT query AS pair, min(doc) AS positive FROM gold GROUP BY query),
manual AS (SELECT pair, positive, m AS neg, 0 AS tier, o AS ord, 'manual' AS source FROM pairs, (VALUES (3, 0), (5, 1)) t(m, o) WHERE m <> positive AND pair % 2 = 0 AND m IN (SELECT doc FROM parsed)),
mined AS (SELECT p.pair, p.positive, h.doc AS neg, 1 AS tier, h.rank AS ord, 'bm25' AS source FROM hits h JOIN pairs p ON p.pair = h.query JOIN parsed a ON a.doc = p.positive JOIN parsed p2 ON p2.doc = h.doc
  WHERE h.doc <> p.positive AND NOT EXISTS (SELECT 1 FROM gold g WHERE g.query = p.pair AND g.doc = h.doc) AND {_JACCARD.replace('p.terms', 'p2.terms')} < 0.85),
once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pair, neg ORDER BY tier, ord) AS n FROM (SELECT * FROM manual UNION ALL SELECT * FROM mined)) WHERE n = 1)
SELECT * FROM (SELECT pair, positive, neg, source, CAST(row_number() OVER (PARTITION BY pair ORDER BY tier, ord, neg) AS INTEGER) AS place FROM once) WHERE place <= 5"""


@register("hard_negatives", _MINE_SQL)
def hard_negatives(spark, sf_dir):
    chunks = docs_of(spark, sf_dir).select(F.col("doc_id").alias("doc"), tokens(F.col("text")).alias("terms"))
    hits = _hits(spark, sf_dir, k=POOL).select(F.col("query").alias("pair"), "doc", "rank")
    return mine.hard_negatives(_pairs(spark, sf_dir), hits, chunks, fill=False)


_HEX = lambda x: f"CAST('0x' || substr(md5({x}), 1, 12) AS BIGINT)"
_FILLED_SQL = f"""WITH {bm25_sql(k=3)}, {_GOLD},
pairs AS (SELECT query AS pair, min(doc) AS positive, count(*) AS n_extra FROM gold GROUP BY query),
manual AS (SELECT pair, positive, m AS neg, 0 AS tier, o AS ord, 'manual' AS source FROM pairs, (VALUES (3, 0), (5, 1)) t(m, o) WHERE m <> positive AND pair % 2 = 0),
barred AS (SELECT query AS pair, doc AS neg FROM gold),
mined AS (SELECT p.pair, p.positive, h.doc AS neg, 1 AS tier, h.rank AS ord, 'bm25' AS source FROM hits h JOIN pairs p ON p.pair = h.query JOIN parsed a ON a.doc = p.positive JOIN parsed p2 ON p2.doc = h.doc
  WHERE NOT EXISTS (SELECT 1 FROM barred g WHERE g.pair = p.pair AND g.neg = h.doc) AND {_JACCARD.replace('p.terms', 'p2.terms')} < 0.85),
size AS (SELECT count(*) AS total FROM parsed), most AS (SELECT max(n_extra + coalesce(m, 0)) AS most FROM pairs LEFT JOIN (SELECT pair, count(*) AS m FROM manual GROUP BY pair) USING (pair)),
n AS (SELECT total, greatest(1, least(total, 17 + most)) AS n FROM size, most),
places AS (SELECT doc AS neg, row_number() OVER (ORDER BY md5('42|' || doc), doc) - 1 AS spot FROM parsed),
draws AS (SELECT pair, positive, (j * total) // n + {_HEX("'42|' || pair || '|' || j")} % (((j + 1) * total) // n - (j * total) // n) AS spot FROM pairs, n, unnest(range(n)) t(j)),
others AS (SELECT pair, positive, neg, 2 AS tier, {_HEX("'42|' || pair || '|' || neg")} AS ord, 'random' AS source FROM draws JOIN places USING (spot) WHERE NOT EXISTS (SELECT 1 FROM barred b WHERE b.pair = draws.pair AND b.neg = places.neg)),
every AS (SELECT * FROM manual WHERE neg IN (SELECT doc FROM parsed) UNION ALL SELECT * FROM mined UNION ALL SELECT * FROM others),
once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pair, neg ORDER BY tier, ord) AS k FROM every) WHERE k = 1)
SELECT * FROM (SELECT pair, positive, neg, source, CAST(row_number() OVER (PARTITION BY pair ORDER BY tier, ord, neg) AS INTEGER) AS place FROM once) WHERE place <= 8"""


@register("hard_negatives_filled", _FILLED_SQL)
def hard_negatives_filled(spark, sf_dir):
    chunks = docs_of(spark, sf_dir).select(F.col("doc_id").alias("doc"), tokens(F.col("text")).alias("terms"))
    hits = _hits(spark, sf_dir, k=3).select(F.col("query").alias("pair"), "doc", "rank")
    return mine.hard_negatives(_pairs(spark, sf_dir), hits, chunks, per_positive=8)


# --- ids, sessions, counts -------------------------------------------------------------------------------


@register(
    "dup_id_disambiguate",
    "SELECT doc_id, CASE WHEN n > 1 THEN base || '__occ' || n ELSE base END AS chunk_id FROM (SELECT doc_id, base, row_number() OVER (PARTITION BY base ORDER BY doc_id) AS n FROM (SELECT doc_id, lang || '__' || substr(md5(text), 1, 3) AS base FROM documents))",
)
def dup_id_disambiguate(spark, sf_dir):
    base = F.concat_ws("__", "lang", F.substring(F.md5("text"), 1, 3))
    return ids.disambiguate(docs_of(spark, sf_dir).select("doc_id", base.alias("chunk_id")), "chunk_id", "doc_id")


@register(
    "session_list",
    """SELECT conv_id, CAST(turns AS BIGINT) AS turns, trim(translate(CASE WHEN length(first) > 35 THEN substr(first, 1, 35) || '...' WHEN first = '' THEN 'Cuộc hội thoại mới' ELSE first END, chr(10), ' ')) AS title
    FROM (SELECT conv_id, count(*) AS turns, coalesce(min_by(text, turn), '') AS first FROM conversations GROUP BY conv_id)""",
)
def session_list(spark, sf_dir):
    by = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), F.min_by("text", "turn").alias("first"))
    return by.select("conv_id", "turns", ids.title(F.col("first")).alias("title"))


@register("chunk_type_counts", "SELECT lang, count(*) AS n FROM documents GROUP BY lang")
def chunk_type_counts(spark, sf_dir):
    return evaluate.count_by(docs_of(spark, sf_dir), "lang")


_HISTORY_SQL = """SELECT conv_id, string_agg('- ' || CASE WHEN role = 'user' THEN 'Người dùng' ELSE 'Trợ lý' END || ': ' || CASE WHEN length(t) > 200 THEN substr(t, 1, 200) || '...' ELSE t END, chr(10) ORDER BY turn) AS history
FROM (SELECT conv_id, turn, role, trim(coalesce(text, ''), ' ') AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations) WHERE back <= 5 GROUP BY conv_id"""


@register("history_render", _HISTORY_SQL)
def history_render(spark, sf_dir):
    by = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("m"))
    return by.select("conv_id", query.history(F.col("m")).alias("history"))


# --- rules on sample rows --------------------------------------------------------------------------------


@register("tag_labels", S.TAGS_SQL)
def tag_labels(spark, sf_dir):
    df = S.frame(spark, S.CLAUSES, "id int, text string").withColumn("m", tag.metadata(F.col("text")))
    join = lambda c: F.array_join(f"m.{c}", ",").alias(c)
    return df.select("id", join("vehicle_type"), join("violation_type"), join("sanctions"))


@register("fine_extract", S.FINES_SQL)
def fine_extract(spark, sf_dir):
    return S.frame(spark, S.CLAUSES, "id int, text string").select("id", tag.fines(F.col("text")).alias("f")).select("id", "f.*")


def _cited(spark):
    return cite.cited(S.frame(spark, S.ANSWERS, "answer_id int, answer string, query string"))


def _evidence(spark):
    return S.frame(spark, S.EVIDENCE, "answer_id int, doc_short string, dieu string, khoan string, diem string, metadata struct<vehicle_type:array<string>>")


@register("citation_extract", S.CITATIONS_SQL)
def citation_extract(spark, sf_dir):
    return _cited(spark).withColumn("place", F.col("place").cast("int"))


@register("citation_support", S.SUPPORT_SQL)
def citation_support(spark, sf_dir):
    return cite.supported(_cited(spark), _evidence(spark)).select("answer_id", F.col("place").cast("int").alias("place"), "supported")


@register("citation_hallucinated", f"{S.SUPPORT_SQL} WHERE NOT supported")
def citation_hallucinated(spark, sf_dir):
    return cite.hallucinated(_cited(spark), _evidence(spark)).select("answer_id", F.col("place").cast("int").alias("place"), F.lit(False).alias("supported"))


@register("citation_validate")
def citation_validate(spark, sf_dir):
    return cite.validate(S.frame(spark, S.ANSWERS, "answer_id int, answer string, query string"), _evidence(spark))


@register("legal_chunks")
def legal_chunks(spark, sf_dir):
    docs = S.frame(spark, S.DECREES, "source_doc string, doc_short string, text string")
    return ids.disambiguate(tag.attach(chunk.chunk_documents(docs)), "chunk_id", "doc_short", "seq")


@register("chunk_split_oversize")
def chunk_split_oversize(spark, sf_dir):
    docs = S.frame(spark, S.DECREES, "source_doc string, doc_short string, text string")
    return chunk.chunk_documents(docs, chunk.Options(max_chunk_chars=80))


_TRIM = lambda x: f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"
_CHUNKS_SQL = rf"""WITH l AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL),
n AS (SELECT doc_id, source, i, {_TRIM("regexp_replace(i || '. ' || raw, '[ 	]+', ' ', 'g')")} AS line, {_TRIM("regexp_replace(raw, '[ 	]+', ' ', 'g')")} AS x FROM l),
stop AS (SELECT doc_id, coalesce(min(CASE WHEN x = '' OR i > 999 THEN i END), 1000000000) AS b FROM n GROUP BY doc_id),
c AS (SELECT n.*, b, CASE WHEN b = 1 THEN 0 ELSE least(i, b - 1) END AS k FROM n JOIN stop USING (doc_id)),
g AS (SELECT doc_id, source, k, string_agg(CASE WHEN i < b THEN x ELSE line END, chr(10) ORDER BY i) AS text FROM c GROUP BY ALL),
o AS (SELECT *, length(text) > 1800 AND contains(text, chr(10)) AS long FROM g)
SELECT 'D' || doc_id || '__Dieu_1' || CASE WHEN k > 0 THEN '__Khoan_' || k ELSE '' END || CASE WHEN long THEN '__lead' ELSE '' END AS chunk_id, source AS source_doc, 'D' || doc_id AS doc_short, CAST(NULL AS VARCHAR) AS chuong, CAST(NULL AS VARCHAR) AS chuong_title,
  CAST(NULL AS VARCHAR) AS muc, CAST(NULL AS VARCHAR) AS muc_title, '1' AS dieu, 'Whole text' AS dieu_title, CASE WHEN k > 0 THEN CAST(k AS VARCHAR) END AS khoan, CAST(NULL AS VARCHAR) AS diem, text,
  CASE WHEN k > 0 THEN 'Khoản ' || k || ' ' ELSE '' END || 'Điều 1 ' || source AS full_citation, CASE WHEN k > 0 OR long THEN 'khoan' ELSE 'dieu' END AS chunk_type, CAST(length(text) AS INTEGER) AS char_count,
  CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS INTEGER) AS seq FROM o"""


@register("document_chunks", _CHUNKS_SQL)
def document_chunks(spark, sf_dir):
    """The chunker over every document's text, its lines numbered as clauses of one article."""
    docs = docs_of(spark, sf_dir)
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x))
    text = F.concat(F.lit("Điều 1. Whole text\n"), F.array_join(lines, "\n"))
    return chunk.chunk_documents(docs.select(F.col("source").alias("source_doc"), F.concat(F.lit("D"), F.col("doc_id").cast("string")).alias("doc_short"), text.alias("text")))


@register("table_linear", S.LINEAR_SQL)
def table_linear(spark, sf_dir):
    t = S.frame(spark, S.TABLES, "id int, rows array<array<string>>")
    return t.select("id", tables.to_linear(tables.clean_rows(F.col("rows"))).alias("linear"))


@register("table_markdown", S.MARKDOWN_SQL)
def table_markdown(spark, sf_dir):
    t = S.frame(spark, S.TABLES, "id int, rows array<array<string>>")
    return t.select("id", tables.to_markdown(tables.clean_rows(F.col("rows"))).alias("markdown"))


def rewrite_slang(spark, sf_dir):  # registered with its SQL in law_queries
    return S.frame(spark, S.QUESTIONS, "query_id int, text string").select("query_id", query.rewrite(F.col("text")).alias("rewritten"))


@register("deconstruct")
def deconstruct(spark, sf_dir):
    df = S.frame(spark, S.QUESTIONS, "query_id int, text string")
    return df.select("query_id", F.posexplode(query.deconstruct(F.col("text"))).alias("intent", "question"))


@register("route_complexity")
def route_complexity(spark, sf_dir):
    return S.frame(spark, S.QUESTIONS, "query_id int, text string").select("query_id", query.route(F.col("text")).alias("route"))


@register("thought_split", S.THOUGHT_SQL)
def thought_split(spark, sf_dir):
    return S.frame(spark, S.REPLIES, "id int, text string").select("id", query.split_answer(F.col("text")).alias("s")).select("id", "s.*")


@register("vn_numbers", S.NUMBERS_SQL)
def vn_numbers(spark, sf_dir):
    return S.frame(spark, S.AMOUNTS, "id int, text string").select("id", evaluate.spelled_numbers(F.col("text")).alias("plain"))


@register("answer_judgement")
def answer_judgement(spark, sf_dir):
    df = S.frame(spark, S.JUDGED, "id int, answer string, expected array<string>, context string")
    a, e = F.col("answer"), F.col("expected")
    return df.select("id", evaluate.missing(a, e).alias("missing"), evaluate.self_contradiction(a).alias("contradicts"), evaluate.root_cause(a, e, F.col("context")).alias("rca"),
                     evaluate.calculation_accuracy(a, F.flatten(F.transform(e, evaluate.expected_fines))).alias("accuracy"))


def rag_chunks(spark, sf_dir):
    """Every document as an article."""
    null = lambda kind: F.lit(None).cast(kind)
    labels = F.struct(F.array().cast("array<string>").alias("vehicle_type"), F.array().cast("array<string>").alias("violation_type"))
    return docs_of(spark, sf_dir).select(
        F.col("doc_id").cast("string").alias("chunk_id"), F.col("source").alias("doc_short"), F.lit("1").alias("dieu"), null("string").alias("khoan"), null("string").alias("diem"),
        null("string").alias("dieu_title"), "text", F.lit("dieu").alias("chunk_type"), labels.alias("metadata"),
    )


@register("rag_batch")
def rag_batch(spark, sf_dir):
    """All benchmark items asked over all documents, with the stand-in predictor and no generator."""
    return pipeline.answer(questions_of(spark, sf_dir), rag_chunks(spark, sf_dir))


from . import law_queries, store_queries  # noqa: E402, F401  (they register their queries)
