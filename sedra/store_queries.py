"""Queries of sources, sinks and stores: what is written is read again, and must be what the SQL finds in the table itself.

Files go to a folder of their own in the shared checkpoint folder.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import functions as F

from .operators import bm25, chunk, dense, evaluate, fusion, ids, tables
from .functions.text import tokens
from .plans import pipeline
from .plans.stages import shared_dir
from .queries import K, POOL, PADDED_SQL, _per_query, _metrics_sql, _GOLD, _rrf_sql, bm25_sql, docs_of, questions_of, register, table
from .sources import files


def folder(spark) -> str:
    return f"{shared_dir(spark)}/files-{uuid.uuid4().hex}"


@register("articles_csv", "SELECT CAST(doc_id AS VARCHAR) AS article_number, CASE WHEN doc_id % 3 > 0 THEN lang END AS chapter_number, source AS doc_short, md5(text) AS content_hash, len(text) AS n FROM documents WHERE source = 'src1' AND text <> ''")
def articles_csv(spark, sf_dir):
    """Article rows as CSV with a byte order mark and line breaks inside quotes."""
    path = folder(spark)
    rows = docs_of(spark, sf_dir).where("text <> ''").select(
        F.when(F.expr("doc_id % 3 > 0"), F.col("lang")).alias("﻿chapter_number"), F.lit("T").alias("chapter_title"), F.col("doc_id").alias("article_number"), F.lit(None).cast("string").alias("article_title"),
        F.col("text").alias("content"), F.col("source").alias("doc_short"), F.lit("S").alias("source_doc"),
    )
    rows.write.csv(path, header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    got = files.read_articles(spark, path, only="src1")
    return got.select("article_number", "chapter_number", "doc_short", F.md5("content").alias("content_hash"), F.length("content").cast("long").alias("n"))


@register("jsonl_rows", "SELECT doc_id, md5(text) AS hash, lang, CASE WHEN doc_id % 2 = 0 THEN source END AS source FROM documents")
def jsonl_rows(spark, sf_dir):
    """A JSON object a line, nulls kept."""
    path = folder(spark)
    files.write_jsonl(docs_of(spark, sf_dir).select("doc_id", "text", "lang", F.when(F.expr("doc_id % 2 = 0"), F.col("source")).alias("source")), path)
    return files.read_jsonl(spark, path, "doc_id long, text string, lang string, source string").select("doc_id", F.md5("text").alias("hash"), "lang", "source")


@register("json_columns", "SELECT doc_id, lang, source, n_chars FROM documents")
def json_columns(spark, sf_dir):
    """Rows as JSON texts and back, nested ones included."""
    rows = docs_of(spark, sf_dir).select("doc_id", F.struct("lang", F.array("source").alias("sources")).alias("m"), "n_chars")
    back = files.from_json(files.as_json(rows, "doc_id"), "doc_id long, m struct<lang:string,sources:array<string>>, n_chars long")
    return back.select("doc_id", "m.lang", F.col("m.sources")[0].alias("source"), "n_chars")


@register("yaml_settings", "SELECT * FROM (VALUES ('bm25.k1', '1.5'), ('dense.model', 'không có'), ('top_k', '10')) t(name, value)")
def yaml_settings(spark, sf_dir):
    """A configuration file, flattened."""
    path = folder(spark)
    spark.createDataFrame([("bm25:\n  k1: 1.5\ndense: {model: 'không có'}\ntop_k: 10",)], "value string").coalesce(1).write.text(path)
    got = files.read_yaml(path, spark)
    flat = [(f"{k}.{x}", str(y)) for k, v in got.items() if isinstance(v, dict) for x, y in v.items()] + [(k, str(v)) for k, v in got.items() if not isinstance(v, dict)]
    return spark.createDataFrame(flat, "name string, value string")


@register("pairs_jsonl", "SELECT text AS query, 'c' || item_id AS positive, CASE WHEN item_id % 2 = 0 THEN 'x,y' ELSE '' END AS extra, '' AS manual FROM benchmark")
def pairs_jsonl(spark, sf_dir):
    """Training pairs; missing arrays are empty."""
    path = folder(spark)
    rows = table(spark, sf_dir, "benchmark").select(F.col("text").alias("query"), F.concat(F.lit("c"), F.col("item_id").cast("string")).alias("positive_chunk_id"), F.when(F.expr("item_id % 2 = 0"), F.array(F.lit("x"), F.lit("y"))).alias("extra_positive_ids"))
    rows.write.json(path)
    return files.read_pairs(spark, path).select("query", F.col("positive_chunk_id").alias("positive"), F.array_join("extra_positive_ids", ",").alias("extra"), F.array_join("manual_negative_ids", ",").alias("manual"))


@register("chunks_by_key", "SELECT CASE WHEN doc_id % 3 = 0 THEN 'g' || doc_id // 9 ELSE 'c' || doc_id END AS chunk_id, max(doc_id) AS doc_id FROM documents WHERE doc_id % 7 > 0 GROUP BY 1")
def chunks_by_key(spark, sf_dir):
    """Chunks by key from JSON lines: of repeated keys the last line stays, lines without a key go."""
    path = folder(spark)
    key = F.when(F.expr("doc_id % 3 = 0"), F.concat(F.lit("g"), F.expr("doc_id div 9").cast("string"))).otherwise(F.concat(F.lit("c"), F.col("doc_id").cast("string")))
    keyed = F.expr("doc_id % 7 > 0")
    rows = docs_of(spark, sf_dir).select("doc_id", F.when(keyed & F.expr("doc_id % 2 = 0"), key).alias("chunk_id"), F.when(keyed & F.expr("doc_id % 2 = 1"), key).alias("id"), F.expr("doc_id div 9").alias("g"))
    rows.repartition(F.col("g")).sortWithinPartitions("doc_id").drop("g").write.json(path)
    return files.read_chunks(spark, path, "chunk_id string, id string, doc_id long").select("chunk_id", "doc_id")


@register("test_matrix", "SELECT 'case_' || item_id AS id, 'c' || (item_id % 4) AS category, text AS user_query FROM benchmark")
def test_matrix(spark, sf_dir):
    """Test cases from JSON arrays."""
    path = folder(spark)
    cases = table(spark, sf_dir, "benchmark").select(F.struct(F.concat(F.lit("case_"), F.col("item_id").cast("string")).alias("id"), F.concat(F.lit("c"), F.expr("item_id % 4").cast("string")).alias("category"), F.col("text").alias("user_query")).alias("c"), F.expr("item_id div 50").alias("g"))
    cases.groupBy("g").agg(F.to_json(F.collect_list("c")).alias("value")).select("value").write.text(path)
    return evaluate.load_matrix(spark, path).select("id", "category", "user_query")


@register("metrics_csv", f"WITH {bm25_sql()}, {_GOLD}, {_metrics_sql('hits')} SELECT query, n_gold, round(rr, 6) AS rr FROM each")
def metrics_csv(spark, sf_dir):
    """Metrics of every question, as a CSV file with a header."""
    path = folder(spark)
    evaluate.write_metrics(_per_query(spark, sf_dir).select("query", "n_gold", F.round("rr", 6).alias("rr")), path)
    return spark.read.schema("query long, n_gold long, rr double").csv(path, header=True)


@register("judged_csv", "SELECT conv_id, 2 AS n_contexts, round((conv_id % 10) / 10.0::DOUBLE, 3) AS faithfulness, round((conv_id % 7) / 10.0::DOUBLE, 3) AS context_recall FROM conversations WHERE turn = 0")
def judged_csv(spark, sf_dir):
    """Judged answers as a CSV file; a stand-in judge scores by the row's number."""
    path = folder(spark)
    cases = table(spark, sf_dir, "conversations").where("turn = 0").select("conv_id", F.col("text").alias("question"), F.lit("a").alias("answer"), F.array(F.lit("x"), F.lit("y")).alias("contexts"), F.col("conv_id").alias("ground_truth"))
    judge = lambda metric, q, a, c, truth: F.round(truth % (10 if metric == "faithfulness" else 7) / 10.0, 3)
    files.write_csv(files.ragas_rows(evaluate.judged(cases, judge, ("faithfulness", "context_recall"))).drop("question"), path)
    got = spark.read.csv(path, header=True)
    return got.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("n_contexts").cast("int").alias("n_contexts"), F.col("faithfulness").cast("double").alias("faithfulness"), F.col("context_recall").cast("double").alias("context_recall"))


@register("mined_dump", "SELECT doc_id AS pair, lang AS query, source AS positive FROM documents")
def mined_dump(spark, sf_dir):
    """Mined examples as JSON lines, without the negatives' texts."""
    path = folder(spark)
    rows = docs_of(spark, sf_dir).select(F.col("doc_id").alias("pair"), F.col("lang").alias("query"), F.col("source").alias("positive"), F.array("text").alias("negatives"))
    files.write_jsonl(files.mined_rows(rows), path)
    return spark.read.json(path).select("pair", "query", "positive")


_SAMPLES = 25


@register("distilled", f"SELECT 'Sinh' AS system, md5(trim(text, ' ' || chr(10))) AS context_hash, 'Q' || (ascii(text) % 5) AS question, 'A' AS answer FROM (SELECT doc_id, text FROM documents WHERE trim(text, ' ' || chr(10)) <> '' ORDER BY doc_id LIMIT {_SAMPLES}) WHERE ascii(text) % 5 > 0")
def distilled(spark, sf_dir):
    """Training examples that a stand-in model makes of the first chunks (the number is the feature); a reply without a question gives none."""
    path = folder(spark)
    chunks = docs_of(spark, sf_dir).select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("dieu_title"), "text", F.lit("c").alias("full_citation"))
    first = lambda m: F.ascii(F.split(m[1]["content"], "\n")[2]) % 5
    model = lambda m: F.when(first(m) == 0, F.lit("no JSON")).otherwise(F.to_json(F.struct(F.concat(F.lit(" Q"), first(m).cast("string")).alias("question"), F.lit("A ").alias("answer"))))
    files.write_jsonl(pipeline.distill(chunks, model, _SAMPLES, system="Sinh"), path)
    return files.read_jsonl(spark, path, "system string, context string, question string, answer string").select("system", F.md5("context").alias("context_hash"), "question", "answer")


# --- stores ----------------------------------------------------------------------------------------------


@register("bm25_saved", PADDED_SQL)
def bm25_saved(spark, sf_dir):
    """The same hits from an index that was saved and loaded."""
    path = folder(spark)
    bm25.save_index(bm25.build_index(docs_of(spark, sf_dir)), path)
    return bm25.search(bm25.load_index(spark, path), questions_of(spark, sf_dir), K)


@register("vector_store", "WITH n AS (SELECT count(*) AS n, count(*) FILTER (WHERE vec_id % 2 = 0) AS even FROM embeddings) SELECT unnest(['empty', 'added', 'upserted', 'reset']) AS step, unnest([0, even, n, 0]) AS n FROM n")
def vector_store(spark, sf_dir):
    """Counts after adding, upserting and resetting."""
    store, e = dense.VectorTable(spark, folder(spark)), table(spark, sf_dir, "embeddings")
    steps = [("empty", store.count())]
    store.add(e.where("vec_id % 2 = 0"))
    steps.append(("added", store.count()))
    store.upsert(e)
    steps.append(("upserted", store.count()))
    store.reset()
    steps.append(("reset", store.count()))
    return spark.createDataFrame(steps, "step string, n long")


@register("vector_add", "SELECT vec_id, label FROM embeddings UNION ALL SELECT vec_id + 1000000, label FROM embeddings WHERE vec_id % 3 = 0")
def vector_add(spark, sf_dir):
    """New vectors beside the old; a key that exists already would be an error."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    return dense.add(e, e.where("vec_id % 3 = 0").withColumn("vec_id", F.col("vec_id") + 1000000))


@register(
    "session_log",
    """SELECT CAST(conv_id AS VARCHAR) AS conversation_id, coalesce(min_by(CASE WHEN length(text) > 35 THEN substr(text, 1, 35) || '...' ELSE text END, turn), '') AS title, CAST(count(*) AS INTEGER) AS n_messages
    FROM conversations WHERE conv_id <> 2 GROUP BY conv_id UNION ALL SELECT 'new', 'New', 1""",
)
def session_log(spark, sf_dir):
    """All conversations of a user saved, one replaced and one deleted, then read."""
    store = ids.Sessions(spark, folder(spark))
    c = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").cast("string").alias("conversation_id"))
    said = F.transform(F.sort_array(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))), lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
    first = F.coalesce(F.min_by("text", "turn"), F.lit(""))
    rows = c.agg(F.when(F.length(first) > 35, F.concat(F.substring(first, 1, 35), F.lit("..."))).otherwise(first).alias("title"), F.lit("2024").alias("ts"), said.alias("messages"))
    store.save_all("u", rows)
    store.save("u", "new", "Old", "2025", [("user", "x"), ("assistant", "y")])
    store.save("u", "new", "New", "2025", [("user", "x")])
    store.delete("u", "2")
    return store._read("u").select("conversation_id", "title", F.size("messages").alias("n_messages"))


# --- before the chunker ----------------------------------------------------------------------------------


@register("inline_markers", "SELECT doc_id, 'Mở đầu ' || lang || chr(10) || '1. ' || source || chr(10) || 'a) một' || chr(10) || 'đ) hai' || chr(10) || '2. x ' || doc_id || 'b) y' AS text FROM documents")
def inline_markers(spark, sf_dir):
    """Inline clause and point numbers moved to the starts of lines; one that follows a digit without a space stays."""
    raw = F.concat(F.lit("  Mở đầu "), "lang", F.lit(" 1. "), "source", F.lit(" a) một\r\nđ) hai   2.  x "), F.col("doc_id").cast("string"), F.lit("b) y "))
    return docs_of(spark, sf_dir).select("doc_id", chunk.with_markers(raw).alias("text"))


@register(
    "synthetic_documents",
    """WITH a AS (SELECT doc_id AS s, doc_id // 5 AS d, CASE WHEN doc_id % 5 = 2 THEN NULL ELSE 'Chương ' || (doc_id % 5 // 3 + 1) END AS ch, lang FROM documents),
    b AS (SELECT *, last_value(ch IGNORE NULLS) OVER (PARTITION BY d ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM a)
    SELECT 'D' || d AS doc_short, string_agg(CASE WHEN ch IS NOT NULL AND ch IS DISTINCT FROM prev THEN ch || '. T' || chr(10) ELSE '' END || 'Điều ' || s || '. ' || lang || chr(10) || CASE WHEN s % 4 > 0 THEN 'Nội dung' || chr(10) || '1. x' || chr(10) ELSE '' END, chr(10) ORDER BY s) AS text FROM b GROUP BY d""",
)
def synthetic_documents(spark, sf_dir):
    """Article rows put together as documents, with a heading wherever the chapter changes."""
    n = F.col("doc_id")
    rows = docs_of(spark, sf_dir).select(
        n.alias("doc_seq"), F.concat(F.lit("D"), F.expr("doc_id div 5").cast("string")).alias("doc_short"), F.lit("S").alias("source_doc"), F.when(n % 5 != 2, F.concat(F.lit("Chương "), F.expr("doc_id % 5 div 3 + 1").cast("string"))).alias("chapter_number"),
        F.lit("T").alias("chapter_title"), n.cast("string").alias("article_number"), F.col("lang").alias("article_title"), F.when(n % 4 > 0, F.lit("Nội dung 1. x")).when(n % 8 == 0, F.lit(" ")).alias("content"),
    )
    return chunk.synthetic_documents(rows).select("doc_short", "text")


@register("clean_pages", "SELECT doc_id, 'Đầu trang' || chr(10) || 'tiếp nối ' || lang || chr(10) || chr(10) || 'cuối' AS text FROM documents")
def clean_pages(spark, sf_dir):
    """Pages of files: broken words joined, blank lines squeezed, page numbers and gazette lines gone."""
    page = F.concat(F.lit(" 12 \nĐầu trang\nCÔNG BÁO/Số "), F.col("doc_id").cast("string"), F.lit("\ntiếp n-\nối "), "lang", F.lit("\n\n\n\n\nTrang 3/9\ncuối\n7\n"))
    return docs_of(spark, sf_dir).select("doc_id", chunk.clean_page(page).alias("text"))



@register(
    "table_chunks",
    """WITH t AS (SELECT doc_id, doc_id % 4 AS k, CASE doc_id % 4 WHEN 0 THEN '| Hành vi | Mức phạt xe ô tô |' || chr(10) || '| --- | --- |' || chr(10) || '| a b |  |' || chr(10) || '| ' || lang || ' |  |'
      WHEN 1 THEN '| Hành vi | ' || lang || '\\|x của xe mô tô |' || chr(10) || '| --- | --- |' || chr(10) || '| y | z |' END AS text FROM documents)
    SELECT 't' || doc_id AS chunk_id, text, CASE k WHEN 0 THEN 'Hành vi: a b.' || chr(10) || 'Hành vi: ' || (SELECT lang FROM documents d WHERE d.doc_id = t.doc_id) || '.' ELSE 'Hành vi: y. ' || (SELECT lang FROM documents d WHERE d.doc_id = t.doc_id) || '|x của xe mô tô: z.' END AS linear_form,
      'Bảng tại trang ' || (doc_id % 30) || ' - S' AS full_citation, CASE k WHEN 0 THEN 3 ELSE 2 END AS row_count, substr(md5(text), 1, 10) AS hash, CASE k WHEN 0 THEN '' ELSE '' END || CASE k WHEN 1 THEN 'xe_may' ELSE '' END AS vehicle_type FROM t WHERE k < 2""",
)
def table_chunks(spark, sf_dir):
    """Tables as chunks; those too small to mean anything go."""
    cell = lambda x: F.lit(x).cast("string")
    rows = (
        F.when(F.expr("doc_id % 4 = 0"), F.array(F.array(cell("Hành vi"), cell("Mức phạt xe ô tô")), F.array(cell(" a  b "), cell(None)), F.array(cell(""), cell("")), F.array(F.col("lang"))))
        .when(F.expr("doc_id % 4 = 1"), F.array(F.array(cell("Hành vi"), F.concat("lang", F.lit("|x của xe mô tô"))), F.array(cell("y"), cell("z"))))
        .when(F.expr("doc_id % 4 = 2"), F.array(F.array(cell("một hàng duy nhất trong bảng"), cell("x")))).otherwise(F.array(F.array(cell("a")), F.array(cell("b"))))
    )
    t = docs_of(spark, sf_dir).select(F.concat(F.lit("t"), F.col("doc_id").cast("string")).alias("table_id"), F.expr("cast(doc_id % 30 as int)").alias("page_num"), rows.alias("rows"), F.lit("S").alias("source_doc"), F.lit("D").alias("doc_short"))
    return tables.table_chunks(t).select("chunk_id", "text", "linear_form", "full_citation", "metadata.row_count", "metadata.hash", F.array_join("metadata.vehicle_type", ",").alias("vehicle_type"))


# --- a lexical and a dense arm ---------------------------------------------------------------------------


def embedded(text):
    """A stand-in for an embedding model: how many tokens fall into each of 16 classes by their md5."""
    first = F.array_join(F.transform(tokens(text), lambda t: F.substring(F.md5(t), 1, 1)), "")
    # As the variable of a lambda the text of first characters is made once, not once for each class.
    counts = lambda s: F.array(*[(F.length(s) - F.length(F.replace(s, F.lit(d), F.lit("")))).cast("double") for d in "0123456789abcdef"])
    return F.transform(F.array(first), counts)[0]


_VECTOR = "list_transform(string_split('0123456789abcdef', ''), lambda d: len(list_filter({0}, lambda x: x = d))::DOUBLE)"
_FIRST = "list_transform({0}, lambda t: substr(md5(t), 1, 1))"


def _true_arms_sql() -> str:
    from .queries import TOKENS_SQL

    firsts = _FIRST.format(TOKENS_SQL)
    return f"""{bm25_sql(k=POOL)}, first AS MATERIALIZED (SELECT * FROM hits),
dv AS MATERIALIZED (SELECT doc, {_VECTOR.format('f')} AS v FROM (SELECT doc_id AS doc, {firsts} AS f FROM documents)), qv AS MATERIALIZED (SELECT query, {_VECTOR.format('f')} AS v FROM (SELECT item_id AS query, {firsts} AS f FROM benchmark)),
near AS (SELECT query, doc, round(coalesce(list_cosine_similarity(q.v, d.v), 0), 6) + 0.0 AS score FROM qv q, (SELECT * FROM dv WHERE list_sum(v) > 0) d UNION ALL SELECT query, doc, 0.0 FROM qv, (SELECT * FROM dv WHERE list_sum(v) = 0)),
second AS MATERIALIZED (SELECT * FROM (SELECT query, doc, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS INTEGER) AS rank, score FROM near) WHERE rank <= {POOL}),
lists AS (SELECT query, doc, rank, 0 AS list_id FROM first UNION ALL SELECT query, doc, rank, 1 FROM second)"""


def true_arms(spark, sf_dir):
    lexical = bm25.search_text(docs_of(spark, sf_dir), questions_of(spark, sf_dir), POOL)
    vectors = docs_of(spark, sf_dir).select(F.col("doc_id").alias("doc"), embedded(F.col("text")).alias("embedding"))
    asked = questions_of(spark, sf_dir).select(F.col("query_id").alias("query"), embedded(F.col("text")).alias("embedding"))
    return lexical, dense.knn(vectors, asked, POOL, id_col="doc").withColumnRenamed("id", "doc")


@register(
    "hybrid_dense",
    f"""WITH {_true_arms_sql()}, {_rrf_sql()} SELECT f.query, f.doc, f.rrf_score, f.rank, a.rank AS bm25_rank, b.rank AS dense_rank, CASE WHEN a.rank IS NOT NULL AND b.rank IS NOT NULL THEN 'both' WHEN a.rank IS NOT NULL THEN 'bm25' ELSE 'dense' END AS retrievers
    FROM fused f LEFT JOIN first a USING (query, doc) LEFT JOIN second b USING (query, doc) WHERE f.rank <= {K}""",
)
def hybrid_dense(spark, sf_dir):
    """Lexical hits fused with those of vectors that are computed from the texts."""
    return fusion.hybrid(*true_arms(spark, sf_dir), K)


@register("hybrid_one_arm", f"WITH {_true_arms_sql()} SELECT query, doc, round(1.0::DOUBLE / (60 + rank), 12) AS rrf_score, rank, rank AS bm25_rank, CAST(NULL AS INTEGER) AS dense_rank, 'bm25' AS retrievers FROM first WHERE rank <= {K}")
def hybrid_one_arm(spark, sf_dir):
    """Without a dense arm the lexical order stays."""
    lexical, _ = true_arms(spark, sf_dir)
    return fusion.hybrid(lexical, lexical.limit(0), K)
