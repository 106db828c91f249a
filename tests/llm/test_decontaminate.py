import re

from sedra.llm import decontaminate as d

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, item string, cell int"
ITEMS = [
    (1, "A train travels 120 km in 3 hours from Springfield to Rivertown and then rests there for 3 hours before it turns back."),
    (2, "the quick brown fox jumps over the lazy dog while seven sleepy cats watch from beneath the old wooden porch"),
    (3, None), (4, ""), (5, "four words are few"),
    (6, "12 34 56 78 90 11 22 33 44 55"),
]


def found(spark, rows, **more):
    docs = spark.createDataFrame([(i, t, "en", "s", 1, "x", 2) for i, t in rows], SCHEMA)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    return {(r.doc_id, r.item_id): r for r in d.leaks(docs, items, **more).collect()}


PAD = " ".join("filler%d" % i for i in range(400))
REPEAT = "A train travels 95 km in 7 hours from Lakeside to Hilltop and then rests there for 7 hours before it turns back."
ROWS = [
    (1, ITEMS[0][1]), (2, PAD + " " + ITEMS[1][1] + " " + PAD), (3, REPEAT),
    (4, REPEAT.replace("rests there for 7", "rests there for 9")),  # the slot that held 3 twice now holds 7 and 9
    (5, PAD), (6, None), (7, ""), (8, "four words are few"), (9, "1 2 3 4 5 6 7 8 9 10"),
    (10, "THE QUICK, BROWN -- FOX JUMPS\nover the lazy dog while seven sleepy cats watch from beneath the old wooden porch!"),
    (11, "the quick brown fox jumps over something else entirely and nothing more of that passage is here"),
    (None, ITEMS[1][1]), (12, ITEMS[1][1]), (12, ITEMS[1][1]),
]


def test_planted_passages(spark):
    want = {(1, 1), (2, 2), (3, 1), (10, 2), (None, 2), (12, 2)}
    for most in (1_000_000, 0):  # with and without the filter on the executors
        got = found(spark, ROWS, max_filter=most)
        assert set(got) == want
        assert got[3, 1].reparameterised and not got[1, 1].reparameterised and not got[2, 2].reparameterised


def test_window_hashes_equal_on_both_paths():
    text = PAD + " " + ITEMS[0][1]
    vocabulary = {}
    plain = d.windows(text, d.Tokens())
    for w in text.split():
        vocabulary[d.core(w)] = d.Tokens()[w] >> d._FLAGS
    assert (d.windows(text, d.Tokens(vocabulary))[3] == plain[3]).all()


def test_verbatim_recall_against_contains(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    norm = lambda t: " ".join(re.findall(r"\w+", t.lower()))
    passages = [(r.item_id, norm(r.text)) for r in items.collect()]
    want = {(r.doc_id, i) for r in docs.collect() for i, p in passages if p in norm(r.text)}
    assert want and {(r.doc_id, r.item_id) for r in d.leaks(docs, items).collect()} == want


def test_drop_and_empty(spark):
    docs = spark.createDataFrame([(i, t, "en", "s", 1, "x", 2) for i, t in ROWS], SCHEMA)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    left = d.drop_leaks(docs, items)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == [4, 5, 6, 7, 8, 9, 11]
    assert sorted(map(str, d.drop_leaks(docs, items, max_broadcast=0).collect())) == sorted(map(str, left.collect()))
    assert d.leaks(docs.limit(0), items).count() == 0
    assert d.leaks(docs, items.limit(0)).count() == 0


def test_adjacent_variants_and_repeating_templates(spark):
    """Alignments next to each other hold other values each; so do those of an item along itself."""
    sells = "Tom buys %s apples for %s dollars at the market and then sells %s of them."
    boxes = "A box holds %s apples and a bag holds %s apples and a crate holds %s apples and a sack holds %s apples."
    inserted = "the train needs 7 hours to the coast and stays there for 7 hours %s before it goes back home again at night"
    items = [(1, sells % (3, 4, 2)), (2, boxes % (3, 5, 8, 9)), (3, (inserted % "").replace("7", "3"))]
    rows = [
        (1, sells % (5, 6, 7)), (2, sells % (5, 6, 7) + " " + sells % (8, 9, 10) + " " + sells % (11, 12, 13)),
        (3, PAD + " " + boxes % (21, 22, 23, 24) + " " + boxes % (31, 32, 33, 34) + " " + PAD), (4, inserted % "or so"), (5, PAD),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = d.leaks(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(1, 1), (2, 1), (3, 2), (4, 3)}
    assert all(r.reparameterised for r in got)


def test_verbatim_without_case_or_punctuation(spark):
    german = "Der Zug verließ den Bahnhof, und die Fahrgäste lasen ihre Zeitung. Danach kam der Schaffner mit Brot und Wein in den Wagen."
    two = "The rain fell on the roof. Water ran down the wall. Nobody in the house had seen it. The night went on and on."
    numbers = "12 + 30 * 4 - 7 = ? 9 + 15"  # no window has two literal words
    items = spark.createDataFrame([(1, german), (2, two), (3, numbers)], "item_id long, text string")
    bare = lambda t: re.sub(r"[^\w\s]", "", t)
    rows, want = [(99, "and " + PAD), (98, "11 + 31 * 5 - 8 = ? 9 + 15")], set()
    for i, (item, t) in enumerate([(1, german), (2, two), (3, numbers)]):
        for k, f in enumerate((str, str.lower, str.upper, str.title, bare, lambda t: bare(t).lower(), lambda t: bare(t).title())):
            rows.append((10 * i + k, PAD + " and " + f(t) + " then " + PAD))
            want.add((10 * i + k, item))
    for most in (1_000_000, 0):
        got = d.leaks(spark.createDataFrame(rows, "doc_id long, text string"), items, max_filter=most).collect()
        assert {(r.doc_id, r.item_id) for r in got} == want
