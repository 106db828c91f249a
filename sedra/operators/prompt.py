"""Prompts and training rows as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import stripped
from ..plans import lexicon as L
from .cite import tag_of
from .query import last
from .tag import _body, _phrases

SYSTEM = (
    "Bạn là trợ lý pháp luật giao thông đường bộ. Hãy lập luận trong thẻ <thought>...</thought>, rồi chỉ trả lời theo các đoạn trong <context>"
    " và kèm trích dẫn nguồn trong ngoặc đơn. Nếu không có quy định phù hợp, hãy nói đúng câu từ chối đã cho."
)
NO_CONTEXT = "(Không có đoạn văn bản nào được cung cấp.)"
ASK = "Hãy trả lời câu hỏi trên CHỈ dựa trên <context>, kèm trích dẫn theo đúng định dạng quy định."


def block(place: Column) -> Column:
    """A chunk in the context: its number and citation tag, title, labels, body, each on a line."""
    vehicles, violations = _phrases(F.col("metadata.vehicle_type"), L.VEHICLE_NAMES), _phrases(F.col("metadata.violation_type"), L.VIOLATION_NAMES)
    named = F.concat_ws(" | ", F.when(vehicles != "", F.concat(F.lit("Đối tượng áp dụng: "), vehicles)), F.when(violations != "", F.concat(F.lit("Hành vi vi phạm: "), violations)))
    head = F.concat(F.lit("[Đoạn "), place.cast("string"), F.lit("] "), tag_of())
    return F.concat_ws("\n", head, F.nullif(stripped(F.col("dieu_title")), F.lit("")), F.nullif(named, F.lit("")), stripped(F.coalesce(_body(), F.lit(""))))


def contexts(sources: DataFrame) -> DataFrame:
    """(query, context): the sources of each query (with position and chunk columns) as numbered blocks."""
    rows = sources.select("query", "position", block(F.col("position")).alias("block"))
    parts = F.sort_array(F.collect_list(F.struct("position", "block")))
    return rows.groupBy("query").agg(F.array_join(F.transform(parts, lambda p: p["block"]), "\n\n").alias("context"))


def user_prompt(question: Column, context: Column, intents: Column) -> Column:
    clean = F.filter(F.transform(intents, lambda i: stripped(F.replace(i, F.lit(";"), F.lit("")))), lambda i: i != "")
    hint = F.when(F.size(clean) > 0, F.concat(F.lit("(Từ khóa pháp lý liên quan: "), F.array_join(clean, ", "), F.lit(")"))).otherwise("")
    return F.concat(F.lit("<context>\n"), F.coalesce(context, F.lit(NO_CONTEXT)), F.lit("\n</context>\n\nCâu hỏi: "), stripped(question), F.lit("\n"), hint, F.lit("\n\n" + ASK))


def messages(question: Column, context: Column, intents: Column, history: Column | None = None, system: str = SYSTEM) -> Column:
    """System message, the last four of the history, user message; each a struct (role, content)."""
    one = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    before = F.array().cast("array<struct<role:string,content:string>>")
    if history is not None:
        before = F.coalesce(F.transform(last(history, 4), lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))), before)
    return F.concat(F.array(one("system", F.lit(system))), before, F.array(one("user", user_prompt(question, context, intents))))


def training_rows(examples: DataFrame, system: str = SYSTEM) -> DataFrame:
    """(messages) for fine-tuning from rows (system, context, question, answer)."""
    user = F.concat(F.lit("<context>\n"), stripped(F.coalesce("context", F.lit(""))), F.lit("\n</context>\n\nCâu hỏi: "), stripped(F.col("question")), F.lit("\n\n" + ASK))
    one = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    return examples.select(F.array(one("system", F.coalesce(F.nullif(F.col("system"), F.lit("")), F.lit(system))), one("user", user), one("assistant", stripped(F.col("answer")))).alias("messages"))


def ranking_rows(mined: DataFrame, texts: DataFrame) -> DataFrame:
    """(query, positive, negatives): listwise examples from mined negatives (pair, query, positive, neg, place) and (doc, text)."""
    t = lambda name: texts.select(F.col("doc").alias(name), F.col("text").alias(f"{name}_text"))
    rows = mined.join(t("positive"), "positive").join(t("neg"), "neg")
    ordered = F.sort_array(F.collect_list(F.struct("place", "neg_text")))
    return rows.groupBy("pair", "query", F.col("positive_text").alias("positive")).agg(F.transform(ordered, lambda x: x["neg_text"]).alias("negatives")).drop("pair")
