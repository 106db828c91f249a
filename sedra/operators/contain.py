"""Which documents contain which passages, verbatim, without comparing all pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.stages import few, staged

#: Words between spaces of any kind; a passage's first and last one can be parts of words of the document.
_SPACE = r"\s+"
ANCHOR = 3


def containing(docs: DataFrame, passages: DataFrame, doc_id: str = "doc_id", doc_text: str = "text", passage_id: str = "item_id", passage_text: str = "text", max_short: int = 1000) -> DataFrame:
    """(query, doc): the documents whose text contains the passage's.

    A passage's anchor is the hash of the three words after its first one; documents whose windows have that hash are looked
    through. Passages of fewer than five words have no anchor: up to max_short of them are looked for in every document, more are an error.
    Null and empty passages are in no document, null texts contain nothing.
    """
    asked = passages.select(F.col(passage_id).alias("query"), F.col(passage_text).alias("passage")).where(F.coalesce("passage", F.lit("")) != "")
    asked = staged(asked.withColumn("words", F.split("passage", _SPACE)))
    anchors = asked.where(F.size("words") >= ANCHOR + 2).select("query", F.xxhash64(F.slice("words", 2, ANCHOR)).alias("h"))
    rows = docs.select(F.col(doc_id).alias("doc"), F.col(doc_text).alias("body"))
    words = F.split("body", _SPACE)
    windows = F.transform(F.sequence(F.lit(1), F.size("words") - (ANCHOR - 1)), lambda i: F.xxhash64(F.slice("words", i, F.lit(ANCHOR))))
    each = rows.withColumn("words", words).where(F.size("words") >= ANCHOR).select("doc", F.explode(F.array_distinct(windows)).alias("h"))
    pairs = staged(each.join(few(anchors), "h").select("query", "doc").distinct())
    found = rows.join(few(pairs), "doc").join(few(asked.select("query", "passage")), "query").where(F.contains("body", "passage")).select("query", "doc")
    short = asked.where(F.size("words") < ANCHOR + 2).select("query", "passage")
    if not (n := short.count()):
        return found.distinct()
    if n > max_short:
        raise ValueError(f"{n} passages of fewer than {ANCHOR + 2} words; {max_short} are the most")
    return found.unionByName(rows.join(F.broadcast(short), F.contains("body", "passage")).select("query", "doc")).distinct()
