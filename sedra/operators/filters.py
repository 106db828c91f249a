"""The metadata filter: a mapping from columns to a value or a list of values, as one Column."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Columns that carry over to the index.
FIELDS = ("doc_short", "source_doc", "chunk_type", "chuong", "muc", "dieu", "khoan", "diem", "dieu_title", "full_citation", "page_num", "char_count")


def _field(schema: T.StructType, name: str) -> T.StructField | None:
    return next((f for f in schema.fields if f.name == name), None)


def clause(schema: T.StructType, name: str, wanted) -> Column:
    """One clause. A missing column and a null are never a match.

    list on both sides: they overlap; a list column and a scalar: it holds it; a scalar column and a list: it
    is one of them; else equality.
    """
    field = _field(schema, name)
    if field is None:
        return F.lit(False)
    many = isinstance(wanted, (list, tuple, set, frozenset))
    col = F.col(f"`{name}`")
    if isinstance(field.dataType, T.ArrayType):
        kind = field.dataType
        out = F.arrays_overlap(col, F.array(*[F.lit(v) for v in wanted]).cast(kind)) if many else F.array_contains(col, F.lit(wanted))
        if many and not wanted:
            return F.lit(False)
    else:
        out = col.isin(list(wanted)) if many else col == F.lit(wanted)
    return F.coalesce(out, F.lit(False))


def condition(df: DataFrame, filters: Mapping | None) -> Column:
    """All clauses together; no filters let everything pass."""
    clauses = [clause(df.schema, k, v) for k, v in (filters or {}).items()]
    return reduce(lambda a, b: a & b, clauses, F.lit(True))


def apply(df: DataFrame, filters: Mapping | None) -> DataFrame:
    return df.where(condition(df, filters))


def flatten_flags(df: DataFrame, prefixes: Mapping[str, tuple[str, list[str]]]) -> DataFrame:
    """Array columns as flags: prefixes maps a column to (prefix, labels). Other array columns go."""
    plain = [F.col(f"`{f.name}`") for f in df.schema.fields if not isinstance(f.dataType, T.ArrayType)]
    flags = [F.coalesce(F.array_contains(f"`{c}`", label), F.lit(False)).alias(prefix + label) for c, (prefix, labels) in prefixes.items() for label in labels]
    return df.select(*plain, *flags)


def index_metadata(chunks: DataFrame) -> DataFrame:
    """chunk_id, the carried fields that chunks has, and the nested metadata; of equal names the nested one wins."""
    nested = _field(chunks.schema, "metadata")
    inner = nested.dataType.names if nested is not None and isinstance(nested.dataType, T.StructType) else []
    top = [c for c in FIELDS if c in chunks.columns and c not in inner]
    return chunks.select("chunk_id", *top, *[F.col(f"metadata.`{c}`").alias(c) for c in inner])
