"""Question answering over a table of questions, all at once; the models are columns or UDFs that the caller gives.

Index, hits and sources are staged: several branches read each of them, and a model's scores are not computed twice.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import stripped, tokens
from ..operators import bm25, cite, dense, fusion, prompt, query, rerank, tag
from .stages import few, staged

Embedder = Callable[[Column], Column]
Generator = Callable[[Column], Column]


@dataclass(frozen=True)
class Settings:
    pool: int = 50
    hybrid_top_k: int = 15
    final_top_k: int = 3
    intent_keep: int = 2
    floor: float = 0.1
    min_score: float | None = None
    refusal: str = "Tôi không tìm thấy quy định phù hợp trong văn bản pháp luật được cung cấp để trả lời câu hỏi này."


def retrieve(questions: DataFrame, index: bm25.Index, settings: Settings = Settings(), vectors: DataFrame | None = None, embedder: Embedder | None = None) -> DataFrame:
    """questions (query_id, text) to fused hits (query, doc, rrf_score, rank, ...). Without an embedder the dense arm is empty."""
    lexical = bm25.search(index, questions, settings.pool)
    if embedder is None or vectors is None:
        near = lexical.limit(0)
    else:
        asked = questions.where(stripped(F.col("text")) != "").select(F.col("query_id").alias("query"), embedder(F.col("text")).alias("embedding"))
        near = dense.knn(vectors, asked, settings.pool, id_col="doc").withColumnRenamed("id", "doc")
    return fusion.hybrid(lexical, near, settings.hybrid_top_k)


def overlap_predictor() -> Column:
    """A stand-in for a cross-encoder: the share of the question's tokens that the chunk's text has."""
    return rerank.overlap(tokens(F.col("question")), tokens(F.col("rerank_text")))


def answer(questions: DataFrame, chunks: DataFrame, settings: Settings = Settings(), predictor: Callable[[], Column] = overlap_predictor, generator: Generator | None = None, vectors: DataFrame | None = None, embedder: Embedder | None = None, reformulator: Generator | None = None) -> DataFrame:
    """(query_id, answer, thought, refused, reply_valid, is_valid, failures, sources, route, rewritten, intents) for each question.

    questions (query_id, text[, history array<struct<role, content>>]); chunks as chunk_documents and attach
    give them. generator: the messages of a question to the model's text; reformulator: the history's lines
    and the question, as one text, to a stand-alone question. A reply that fails validation (reply_valid) gives way to
    the refusal, which is valid: so is_valid, of what is answered, holds for every row.
    """
    q = questions.select("query_id", "text", F.col("history") if "history" in questions.columns else F.array().cast("array<struct<role:string,content:string>>").alias("history"))
    if reformulator is not None:
        reply = reformulator(F.concat(query.history(F.col("history")), F.lit("\n"), F.col("text")))
        q = q.withColumn("text", query.reformulated(F.col("text"), reply, F.size("history") > 0))
    q = q.withColumn("formal", query.rewrite(F.col("text"))).withColumn("asked", query.deconstruct(F.col("text")))
    q = q.withColumn("route", query.route(F.col("text"), F.col("asked"))).withColumn("intents", query.deconstruct(F.col("formal")))
    q = staged(q.withColumn("rewritten", F.array_join("intents", " và ")))
    docs = chunks
    for c in ("linear_form", "full_citation"):
        if c not in docs.columns:
            docs = docs.withColumn(c, F.lit(None).cast("string"))
    docs = docs.withColumn("doc", F.col("chunk_id")).withColumn("rerank_text", tag.rerank_text()).withColumn("embed_text", tag.embed_text())
    index = bm25.build_index(docs, "doc", "embed_text")
    each = q.select("query_id", F.posexplode("intents").alias("intent", "question"), (F.size("intents") > 1).alias("compound"))
    each = each.withColumn("sub", F.concat_ws("#", F.col("query_id").cast("string"), F.col("intent").cast("string")))
    hits = retrieve(each.select(F.col("sub").alias("query_id"), F.col("question").alias("text")), index, settings, vectors, embedder)
    candidates = few(hits).join(docs.select("doc", "rerank_text"), "doc").join(each.select(F.col("sub").alias("query"), "question", "query_id", "intent", "compound"), "query")
    candidates = staged(candidates)
    best = staged(rerank.rerank(candidates, predictor, settings.final_top_k))
    many = rerank.low_confidence_fallback(candidates.where("compound"), best.where("compound"), settings.intent_keep, settings.floor)
    keep = ["query", "intent", "doc", "rank", "cross_encoder_score"]
    merged = rerank.merge_intents(many.select(F.col("query_id").alias("query"), *keep[1:]), settings.final_top_k).select("query", "doc", "cross_encoder_score", F.col("position").alias("rank"))
    single = best.where(~F.col("compound")).select(F.col("query_id").alias("query"), "doc", "cross_encoder_score", "rank")
    sources = few(merged.unionByName(single).withColumn("position", F.row_number().over(Window.partitionBy("query").orderBy("rank"))))
    gated = rerank.gate(sources, q.select(F.col("query_id").alias("query")), settings.min_score)
    full = staged(sources.join(docs, "doc"))
    listed = sources.groupBy("query").agg(F.transform(F.sort_array(F.collect_list(F.struct("position", "doc"))), lambda x: x["doc"]).alias("sources"))
    out = q.join(gated.select(F.col("query").alias("query_id"), "refused"), "query_id").join(prompt.contexts(full).withColumnRenamed("query", "query_id"), "query_id", "left")
    out = out.join(listed.withColumnRenamed("query", "query_id"), "query_id", "left")
    said = prompt.messages(F.col("rewritten"), F.col("context"), F.col("intents"), F.col("history"))
    model = generator(said) if generator is not None else F.lit(None).cast("string")
    out = out.withColumn("reply", query.split_answer(F.when(F.col("refused"), settings.refusal).otherwise(F.coalesce(model, F.lit(settings.refusal)))))
    out = staged(out)
    checked = cite.validate(
        out.select(F.col("query_id").alias("answer_id"), F.col("reply.answer").alias("answer"), F.col("text").alias("query")),
        full.select(F.col("query").alias("answer_id"), "doc_short", "dieu", "khoan", "diem", "metadata"),
    ).select(F.col("answer_id").alias("query_id"), F.col("is_valid").alias("valid"), "failures")
    out = out.join(checked, "query_id")
    return out.select(
        "query_id", F.when(F.col("valid"), F.col("reply.answer")).otherwise(settings.refusal).alias("answer"), F.col("reply.thought").alias("thought"),
        (F.col("refused") | ~F.col("valid")).alias("refused"), F.col("valid").alias("reply_valid"), F.lit(True).alias("is_valid"), "failures", F.coalesce("sources", F.array().cast("array<string>")).alias("sources"), "route", "rewritten", "intents",
    )


def routed(route: Column, local: Generator, cloud: Generator | None = None, mode: str = "auto") -> Generator:
    """A generator that sends a question where its route says; a cloud answer that is null gives way to the local one.

    mode: auto, or local or cloud for all questions.
    """
    if mode not in ("auto", "local", "cloud"):
        raise ValueError(f"unknown mode: {mode}")

    def generate(messages: Column) -> Column:
        if cloud is None or mode == "local":
            return local(messages)
        far = F.lit(True) if mode == "cloud" else route == "cloud"
        return F.coalesce(F.when(far, cloud(messages)), local(messages))

    return generate


def distill(chunks: DataFrame, generator: Generator, max_samples: int = 100, order: str = "chunk_id", system: str = prompt.SYSTEM) -> DataFrame:
    """(system, context, question, answer) from the first max_samples chunks; a reply that is no such JSON gives no row.

    The limit is the feature: so many calls of a model are paid for.
    """
    asked = chunks.where(stripped(F.col("text")) != "").orderBy(order).limit(max_samples)
    ask = F.concat_ws("\n", F.lit("Hãy sinh một câu hỏi và câu trả lời dưới dạng JSON {question, answer} từ văn bản sau."), "dieu_title", stripped(F.col("text")), "full_citation")
    said = F.array(F.struct(F.lit("system").alias("role"), F.lit(system).alias("content")), F.struct(F.lit("user").alias("role"), ask.alias("content")))
    got = asked.select(stripped(F.col("text")).alias("context"), F.from_json(generator(said), "question string, answer string").alias("r"))
    got = got.where(F.col("r.question").isNotNull() & F.col("r.answer").isNotNull())
    return got.select(F.lit(system).alias("system"), "context", stripped(F.col("r.question")).alias("question"), stripped(F.col("r.answer")).alias("answer"))
