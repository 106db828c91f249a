"""Tables as ARRAY<ARRAY<STRING>>: cleaning, Markdown, sentences, and chunks of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tag import metadata


def clean_rows(rows: Column) -> Column:
    """Nulls are empty cells, white space inside cells squeezed, empty rows dropped."""
    cell = lambda c: F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "), "^ | $", "")
    return F.filter(F.transform(rows, lambda r: F.transform(r, cell)), lambda r: F.exists(r, lambda c: c != ""))


def is_meaningful(rows: Column) -> Column:
    """Two rows, some row of several cells, and twenty characters at least."""
    chars = F.aggregate(F.flatten(rows), F.lit(0), lambda a, c: a + F.length(c))
    return (F.size(rows) >= 2) & F.exists(rows, lambda r: F.size(r) > 1) & (chars >= 20)


def to_markdown(rows: Column) -> Column:
    """A header, a rule, and the body; short rows are filled up, bars escaped."""
    width = F.aggregate(rows, F.lit(0), lambda a, r: F.greatest(a, F.size(r)))
    line = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
    full = lambda r: F.concat(F.transform(r, lambda c: F.replace(c, F.lit("|"), F.lit("\\|"))), F.array_repeat(F.lit(""), width - F.size(r)))
    lines = F.transform(rows, lambda r: line(full(r)))
    rule = F.array(line(F.array_repeat(F.lit("---"), width)))
    return F.when(F.size(rows) == 0, "").otherwise(F.array_join(F.concat(F.slice(lines, 1, 1), rule, F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0)))), "\n"))


def to_linear(rows: Column, column_name: str = "Cột") -> Column:
    """A line `header: cell. header: cell.` for each body row, without its empty cells; a lone row is joined by spaces."""
    header = rows[0]

    def sentence(row):
        named = F.transform(row, lambda c, i: F.when(c != "", F.concat(F.coalesce(F.get(header, i), F.concat(F.lit(f"{column_name} "), (i + 1).cast("string"))), F.lit(": "), c)))
        parts = F.array_compact(named)
        return F.when(F.size(parts) > 0, F.concat(F.array_join(parts, ". "), F.lit(".")))

    body = F.slice(rows, F.lit(2), F.greatest(F.size(rows) - 1, F.lit(0)))
    many = F.array_join(F.array_compact(F.transform(body, sentence)), "\n")
    return F.when(F.size(rows) < 2, F.array_join(F.transform(rows, lambda r: F.array_join(r, " ")), " ")).otherwise(many)


def table_chunks(tables: DataFrame) -> DataFrame:
    """tables (table_id, page_num, rows, source_doc, doc_short) to chunk records; meaningless tables go."""
    t = tables.withColumn("rows", clean_rows(F.col("rows"))).where(is_meaningful(F.col("rows")))
    t = t.withColumns({"markdown": to_markdown(F.col("rows")), "linear_form": to_linear(F.col("rows"))})
    t = t.withColumn("text", F.when(F.col("markdown") != "", F.col("markdown")).otherwise(F.col("linear_form")))
    tagged = metadata(F.when(F.col("linear_form") != "", F.col("linear_form")).otherwise(F.array_join(F.transform("rows", lambda r: F.array_join(r, " ")), " ")))
    t = t.withColumn("m", tagged)
    return t.select(
        F.col("table_id").alias("chunk_id"), "source_doc", "doc_short", F.lit("table").alias("chunk_type"), "page_num", "text", "linear_form", "markdown", "rows",
        F.concat(F.lit("Bảng tại trang "), F.col("page_num").cast("string"), F.lit(" - "), F.col("source_doc")).alias("full_citation"), F.length("text").alias("char_count"),
        F.struct("m.vehicle_type", "m.violation_type", "m.fine_min", "m.fine_max", "m.sanctions", F.size("rows").alias("row_count"), F.substring(F.md5("text"), 1, 10).alias("hash")).alias("metadata"),
    )
