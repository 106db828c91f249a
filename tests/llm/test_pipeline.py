import re

import corpus_pipeline
from sedra.llm import mixing, quality

from .test_near_copies import brute_groups

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    columns, rows = docs.columns, {r.doc_id: r for r in docs.collect()}
    expected = {i: quality.judge(r.text) for i, r in rows.items()}
    expected = {i: v[7] for i, v in expected.items() if v[6]}
    norm = lambda t: " ".join(re.findall(r"\w+", t.lower()))
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, SF)
        got = docs.collect()
        docs = spark.createDataFrame(got, docs.schema)
        if k < 4:
            assert docs.columns == columns
            assert all(r.n_chars == len(r.text) for r in got)
        if k == 1:
            ids = sorted(expected)  # five words, a similarity of 0.8 or more
            expected = {ids[min(g)]: expected[ids[min(g)]] for g in brute_groups([expected[i] for i in ids])}
        elif k == 2:
            expected = {i: t for i, t in expected.items() if not any(norm(b) in norm(t) for _, b in items)}
        elif k == 3:
            assert {r.doc_id for r in got} == set(expected)
            assert not any(re.search(r"token = \"", r.text) and r.text == expected[r.doc_id] for r in got)
            expected = {r.doc_id: r.text for r in got}
        if k < 3:
            assert {r.doc_id: r.text for r in got} == expected, name
        if k == 4:
            assert {r.doc_id: r.size for r in got} == {i: len(t.split()) for i, t in expected.items()}
            assert all(0 <= r.taken <= 3 * r.size for r in got)
    assert mixing.Mix().max_epochs == 3


def test_run_equals_stages(spark):
    first = sorted(map(str, corpus_pipeline.run(spark, SF).collect()))
    assert first and first == sorted(map(str, corpus_pipeline.run(spark, SF).collect()))


def test_stages_on_odd_rows(spark):
    """Nulls everywhere, empty and very long texts, repeated rows, clashing extra columns, an empty table."""
    from sedra.llm.common import table

    good = "\n".join(f"The a{i} met b{i} and c{i} agreed d{i} to publish e{i} what f{i} had found." for i in range(8))
    long = " ".join("word%d" % (i * 7919 % 50021) for i in range(60000)) + "."
    extra = "size string, fp string, id string, body string, kept string, doc string, pos string, root string"
    x = ("s", "f", "i", "b", "k", "d", "p", "r")
    rows = [(1, good, "en", "s", 9, *x), (1, good, "en", "s", 9, *x), (2, good + " Tail here.", None, None, None, *[None] * 8), (None, None, None, None, None, *[None] * 8)]
    rows += [(3, "", "en", "s", 0, *x), (4, long, "en", "t", len(long), *x), (None, good.replace("a1 ", "x1 "), "en", "u", 5, *x)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + extra
    for df in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        columns = df.columns
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            df = stage(spark, df, SF)
            got = df.collect()
            if k < 4:
                assert df.columns == columns
                df = spark.createDataFrame(got, df.schema)
        if got:
            assert {r.doc_id for r in got} >= {1, 4} and all(r.size > 0 for r in got)
    assert table(spark, SF, "documents").count() == 200
