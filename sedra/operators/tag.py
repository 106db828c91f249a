"""Controlled-vocabulary labels, fines, and the texts built from chunks."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import AFTER, has, stripped, word
from ..plans import lexicon as L


def labels(text: Column, taxonomy: Mapping[str, str], whole_words: bool = True) -> Column:
    """The labels whose pattern the text has, in the taxonomy's order."""
    pattern = lambda p: word(p.replace(r"\b", AFTER)) if whole_words else f"(?iu){p}"
    return F.array_compact(F.array(*[F.when(has(text, pattern(p)), label) for label, p in taxonomy.items()]))


def fines(text: Column) -> Column:
    """(fine_min, fine_max) of the first fine; nulls without one."""
    amount = lambda g: F.regexp_replace(F.regexp_extract(text, f"(?iu){L.FINE}", g), r"\D", "").try_cast("bigint")
    return F.struct(amount(1).alias("fine_min"), amount(2).alias("fine_max"))


def metadata(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    f = fines(text)
    return F.struct(
        labels(text, L.VEHICLES).alias("vehicle_type"), labels(text, L.VIOLATIONS).alias("violation_type"),
        f["fine_min"].alias("fine_min"), f["fine_max"].alias("fine_max"), labels(text, L.SANCTIONS, whole_words=False).alias("sanctions"),
    )


def attach(chunks: DataFrame) -> DataFrame:
    """chunks with metadata from title and text."""
    return chunks.withColumn("metadata", metadata(F.concat(F.coalesce("dieu_title", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit("")))))


# What tells a vehicle in questions and answers.
MENTIONED = {
    "nguoi_di_bo": "đi bộ|người đi bộ",
    "xe_dap": "xe đạp|xe thô sơ|xe thô-sơ",
    "xe_tho_so": "xe đạp|xe thô sơ|xe thô-sơ",
    "xe_may": "xe máy|mô tô|xe gắn máy|xe mô tô|mô-tô",
    "o_to": "ô tô|xe hơi|xe du lịch|xe tải|xe khách|xe ô-tô",
    "may_keo": "máy kéo",
    "xe_chuyen_dung": "chuyên dùng|xe chuyên dùng|xe máy chuyên dùng",
}


def vehicles_mentioned(text: Column) -> Column:
    return labels(F.coalesce(text, F.lit("")), MENTIONED)


def _phrases(values: Column, table: Mapping[str, str]) -> Column:
    """The values' phrases joined by commas; empty where none is known."""
    known = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.array_join(F.array_compact(F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda v: F.try_element_at(known, v))), ", ")


def _lexicon(meta: str = "metadata") -> Column:
    """Sentences that spell a chunk's labels out."""
    violations, vehicles = _phrases(F.col(f"{meta}.violation_type"), L.VIOLATION_PHRASES), _phrases(F.col(f"{meta}.vehicle_type"), L.VEHICLE_PHRASES)
    first = F.when(violations != "", F.concat(F.lit("Quy định này áp dụng cho lỗi "), violations, F.lit(".")))
    second = F.when(vehicles != "", F.concat(F.lit("Áp dụng cho người điều khiển "), vehicles, F.lit(".")))
    return F.concat_ws(" ", first, second)


def _body() -> Column:
    return F.when((F.col("chunk_type") == "table") & (F.coalesce("linear_form", F.lit("")) != ""), F.col("linear_form")).otherwise(F.col("text"))


def _joined(separator: str, *parts: Column) -> Column:
    return F.concat_ws(separator, *[F.nullif(p, F.lit("")) for p in parts])


def embed_text(with_title: bool = True, with_citation: bool = False, separator: str = ". ") -> Column:
    """The indexed text of a chunk: citation, title, body, then its labels in words."""
    return _joined(separator, *([F.col("full_citation")] if with_citation else []), *([F.col("dieu_title")] if with_title else []), _body(), _lexicon())


def rerank_text(with_title: bool = True, with_citation: bool = False) -> Column:
    """The text a cross-encoder reads: labels come before the body."""
    return _joined(". ", *([F.col("full_citation")] if with_citation else []), *([F.col("dieu_title")] if with_title else []), _lexicon(), _body())


def training_text(with_title: bool = True, with_citation: bool = False) -> Column:
    """The text of a training example: without labels."""
    return _joined(". ", *([F.col("full_citation")] if with_citation else []), *([F.col("dieu_title")] if with_title else []), _body())


def corpus(chunks: DataFrame, tables: DataFrame | None = None, text: Column | None = None) -> DataFrame:
    """(chunk_id, embed_text, and the columns of both): chunks, then tables; blank texts go; an empty corpus is an error."""
    both = chunks if tables is None else chunks.unionByName(tables, allowMissingColumns=True)
    for c in ("linear_form", "full_citation"):
        if c not in both.columns:
            both = both.withColumn(c, F.lit(None).cast("string"))
    out = both.withColumn("embed_text", embed_text() if text is None else text).where(stripped(F.col("embed_text")) != "")
    if not out.limit(1).count():
        raise ValueError("there are no documents to index")
    return out
