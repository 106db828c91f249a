"""Registered queries against their SQL, on the smallest tables."""

import math

import duckdb
import pytest

from sedra.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark labels conversations".split()
NAMES = [
    "chunk_metadata", "index_texts", "index_fields", "citation_tags", "prompt_messages", "training_messages", "number_words", "expected_tags", "tag_coverage", "answer_checks", "failure_modes", "suite_rollup",
    "citation_rates", "rewrite_questions", "rewrite_slang", "reformulated", "vehicles_mentioned", "deconstruct_questions", "route_questions", "validate_answers", "rerank_pass_through", "document_chunks",
    "articles_csv", "jsonl_rows", "json_columns", "yaml_settings", "pairs_jsonl", "chunks_by_key", "judged_csv", "vector_store", "session_log", "synthetic_documents", "table_chunks", "hybrid_dense", "bm25_padded",
]


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    cursor = con.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall()), key=repr)
    assert got == want and got
