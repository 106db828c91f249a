import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sedra.operators import bm25, dense, evaluate, filters, fusion, ids, mine, rerank


def brute_bm25(docs, query, variant, k1=1.5, b=0.75, eps=0.25):
    n, avg = len(docs), sum(map(len, docs)) / len(docs)
    df = Counter(t for d in docs for t in set(d))
    delta = {"okapi": 0, "plus": 1.0, "l": 0.5}[variant]
    if variant == "okapi":
        idf = {t: math.log(n - f + 0.5) - math.log(f + 0.5) for t, f in df.items()}
        mean = sum(idf.values()) / len(idf)
        idf = {t: eps * mean if v < 0 else v for t, v in idf.items()}
    elif variant == "plus":
        idf = {t: math.log((n + 1) / f) for t, f in df.items()}
    else:
        idf = {t: math.log(n + 1) - math.log(f + 0.5) for t, f in df.items()}
    out = []
    for d in docs:
        tf, norm, s = Counter(d), 1 - b + b * len(d) / avg, 0.0
        for t in query:
            if t in idf and variant == "l":
                c = tf[t] / norm
                s += idf[t] * (k1 + 1) * (c + delta) / (k1 + c + delta)
            elif t in idf:
                s += idf[t] * (delta + tf[t] * (k1 + 1) / (tf[t] + k1 * norm))
        out.append(s)
    return out


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(1)
    return [[rng.choice("abcdefghij") for _ in range(rng.randint(1, 30))] for _ in range(40)]


@pytest.mark.parametrize("variant", ["okapi", "plus", "l"])
def test_bm25_equals_brute_force(spark, corpus, variant, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(i, " ".join(d).upper() + ".") for i, d in enumerate(corpus)], "doc_id long, text string")
    asked = [(0, "a b b"), (1, "zz j"), (2, ""), (3, None), (4, "zz")]
    queries = spark.createDataFrame(asked, "query_id long, text string")
    model = bm25.Bm25(variant)
    index = bm25.build_index(docs, model=model)
    bm25.save_index(index, str(tmp_path / "index"))
    loaded = bm25.load_index(spark, str(tmp_path / "index"))
    got = [{(r["query"], r["rank"]): (r["doc"], r["score"]) for r in bm25.search(x, queries, 12, model).collect()} for x in (index, loaded)]
    assert got[0] == got[1]
    for q, text in asked:
        scores = [round(s, 6) + 0.0 for s in brute_bm25(corpus, (text or "").split(), variant)]
        order = sorted(range(len(corpus)), key=lambda i: (-scores[i], i))[:12] if (text or "").split() else []
        mine_ = [got[0][q, k] for k in range(1, 13) if (q, k) in got[0]]
        assert [d for d, _ in mine_] == order and all(abs(s - scores[d]) < 2e-6 for d, s in mine_)
    blocks = sorted(map(tuple, bm25.search_text(docs, queries, 12, model).collect()))
    monkeypatch.setattr(bm25, "MAX_BROADCAST_TERMS", 0)
    assert sorted(map(tuple, bm25.search_text(docs, queries, 12, model).collect())) == blocks
    every = {(q, d): s for (q, _), (d, s) in got[0].items()}
    assert blocks and all(every[b[0], b[1]] == b[3] for b in blocks if (b[0], b[1]) in every)


def test_filter_keeps_corpus_statistics(spark, corpus):
    docs = spark.createDataFrame([(i, " ".join(d), i % 2) for i, d in enumerate(corpus)], "doc_id long, text string, side int")
    queries = spark.createDataFrame([(0, "a b")], "query_id long, text string")
    every = {r["doc"]: r["score"] for r in bm25.search_text(docs, queries, 40).collect()}
    odd = {r["doc"]: r["score"] for r in bm25.search_text(docs, queries, 40, keep=filters.condition(docs, {"side": 1})).collect()}
    assert odd == {d: s for d, s in every.items() if d % 2}
    with pytest.raises(ValueError):
        bm25.Bm25("other")


def test_filter_dsl(spark):
    df = spark.createDataFrame([(1, "x", ["a", "b"]), (2, "y", []), (3, None, None)], "id int, s string, xs array<string>")
    got = lambda f: [r.id for r in filters.apply(df, f).collect()]
    assert got({}) == [1, 2, 3] and got(None) == [1, 2, 3]
    assert got({"s": "x"}) == [1] and got({"s": ["x", "y"]}) == [1, 2] and got({"xs": "b"}) == [1] and got({"xs": ["b", "z"]}) == [1]
    assert got({"nope": 1}) == [] and got({"s": "x", "xs": "z"}) == [] and got({"xs": []}) == []


def test_knn(spark):
    rng = random.Random(2)
    vs = [[rng.gauss(0, 1) for _ in range(5)] for _ in range(60)] + [None]
    df = spark.createDataFrame(list(enumerate(vs)), "vec_id long, embedding array<float>")
    asked = df.where("vec_id < 7").select(F.col("vec_id").alias("query"), "embedding")
    for block in (3, 4096):
        got = dense.knn(df, asked, 4, "ip", block=block).collect()
        for q in range(7):
            best = sorted(range(60), key=lambda i: -sum(a * b for a, b in zip(vs[q], vs[i])))[:4]
            assert [r.id for r in sorted((r for r in got if r["query"] == q), key=lambda r: r["rank"])] == best
    with pytest.raises(ValueError):
        dense.knn(df, asked, metric="hamming")
    new = spark.createDataFrame([(0, [1.0]), (99, [2.0])], df.schema)
    assert dense.upsert(df, new).count() == 62
    assert dense.add(df, new.where("vec_id = 99")).count() == 62
    with pytest.raises(Exception, match="exists already"):
        dense.add(df, new).collect()


def test_knn_holds_few_scores_at_once(spark, monkeypatch):
    rng = random.Random(4)
    vs = [[float(rng.randint(-3, 3)) for _ in range(3)] for _ in range(90)]  # many ties
    df = spark.createDataFrame(list(enumerate(vs)), "vec_id long, embedding array<double>").coalesce(2)
    asked = df.where("vec_id < 30").select(F.col("vec_id").alias("query"), "embedding")
    made = []
    whole = dense._scores
    monkeypatch.setattr(dense, "_scores", lambda metric, x, q: made.append(len(x) * len(q)) or whole(metric, x, q))
    for name, most in (("SCORES_AT_ONCE", 24), ("QUERIES_AT_ONCE", 4)):
        monkeypatch.setattr(dense, name, most)
    for metric in dense.METRICS:
        score = {"ip": lambda a, b: sum(x * y for x, y in zip(a, b)), "l2": lambda a, b: -math.dist(a, b), "cosine": lambda a, b: sum(x * y for x, y in zip(a, b)) / (math.hypot(*a) * math.hypot(*b) or 1)}[metric]
        local = dense.knn(df, asked, 5, metric).collect()
        for q in range(30):
            best = sorted(range(90), key=lambda i: (-round(score(vs[q], vs[i]), 6), i))[:5]
            assert [r.id for r in sorted((r for r in local if r["query"] == q), key=lambda r: r["rank"])] == best
    import numpy as np
    import pyarrow as pa

    shared = type("Shared", (), {"value": np.array(vs[:30])})
    batch = pa.RecordBatch.from_arrays([pa.array(range(90)), pa.array(vs)], ["id", "v"])
    got = {(r["query"], r["id"]) for b in dense._best("ip", 5, list(range(30)), shared)([batch]) for r in b.to_pylist()}
    assert made and max(made) <= 24 and got == {(r["query"], r["id"]) for r in dense.knn(df, asked, 5, "ip").collect()}


def test_vector_table(spark, tmp_path):
    t = dense.VectorTable(spark, str(tmp_path / "v"))
    df = spark.createDataFrame([(1, [1.0]), (2, [2.0])], "vec_id long, embedding array<float>")
    assert t.count() == 0 and t.read() is None
    t.reset()
    t.add(df)
    t.upsert(spark.createDataFrame([(2, [9.0]), (3, [3.0])], df.schema))
    assert {r.vec_id: r.embedding for r in t.read().collect()} == {1: [1.0], 2: [9.0], 3: [3.0]}
    with pytest.raises(Exception, match="exists already"):
        t.add(df)
    assert t.count() == 3
    t.reset()
    assert t.count() == 0


def ranked(spark, *lists):
    return spark.createDataFrame([(0, i, d, k) for i, x in enumerate(lists) for k, d in enumerate(x, 1)], "query int, list_id int, doc string, rank int")


def test_rrf(spark):
    lists = ranked(spark, ["A", "B", "C"], ["B", "A", "D"])
    got = {r["doc"]: (r.rrf_score, r["rank"]) for r in fusion.rrf(lists).collect()}
    assert got["A"][0] == pytest.approx(1 / 61 + 1 / 62, abs=1e-12) and got["A"][1] == 1 and got["B"][1] == 2 and got["C"][1] == 3
    assert next(r["doc"] for r in fusion.rrf(lists, weights=[0.5, 2.0]).collect() if r["rank"] == 1) == "B"
    with pytest.raises(ValueError):
        fusion.rrf(lists, weights=[1.0], n_lists=2)
    e = {r["doc"]: r for r in fusion.explain(lists, ["x", "y"]).collect()}
    assert e["D"].x_rank == float("inf") and e["D"].x_contribution == 0.0 and e["D"].total == pytest.approx(1 / 63)
    assert fusion.rrf(lists.limit(0)).count() == 0


def test_metrics(spark):
    run = spark.createDataFrame([(0, "a", 1), (0, "x", 2), (0, "b", 3), (1, "x", 1), (1, "c", 2), (2, "y", 1)], "query int, doc string, rank int")
    gold = spark.createDataFrame([(0, "a"), (0, "b"), (0, "z"), (1, "c"), (2, "q"), (3, "w")], "query int, doc string")
    m = {r["query"]: r for r in evaluate.per_query(run, gold, (1, 3)).collect()}
    assert m[0].recall_3 == pytest.approx(2 / 3) and m[0].precision_1 == 1 and m[1].precision_3 == 0.5 and m[1].rr == 0.5 and m[2].rr == 0 and m[3].precision_3 == 0
    a, b = evaluate.stage(run, gold, "a", (1,)), evaluate.stage(run.where("query = 0"), gold, "b", (1,))
    got = {r.metric: r for r in evaluate.lift(a, b).collect()}
    assert got["mrr"].before == pytest.approx(1.5 / 4) and got["mrr"].after == pytest.approx(1 / 4) and "MRR" in evaluate.to_markdown(list(got.values()))


def test_rerank_and_merge(spark):
    c = spark.createDataFrame([(0, "a", 1, 0.1, 0.9), (0, "b", 2, 0.5, 0.8), (0, "c", 3, 0.5, 0.7), (1, "d", 1, 0.01, 0.3)], "query int, doc string, rank int, s double, rrf_score double")
    got = rerank.rerank(c, F.col("s"), 2)
    assert [(r["doc"], r["rank"], r.pre_rerank_rank) for r in got.orderBy("query", "rank").collect()] == [("b", 1, 2), ("c", 2, 3), ("d", 1, 1)]
    assert [r["doc"] for r in rerank.rerank(c, None, 2).where("query = 0").orderBy("rank").collect()] == ["a", "b"]
    failed = rerank.rerank(c, F.when(F.col("doc") != "c", F.col("s")), 3, on_error="input_order").where("query = 0")
    assert [(r["doc"], r.cross_encoder_score) for r in failed.orderBy("rank").collect()] == [("a", 3.0), ("b", 2.0), ("c", 1.0)]
    back = rerank.low_confidence_fallback(c, got).collect()
    assert {(r["doc"], r.cross_encoder_score) for r in back} == {("b", 0.5), ("c", 0.5), ("d", 0.3)}
    tops = spark.createDataFrame([(0, 0, "a", 1, 0.2), (0, 0, "b", 2, 0.9), (0, 1, "a", 1, 0.8), (0, 1, "c", 2, 0.5), (0, 2, "e", 1, 0.1)], "query int, intent int, doc string, rank int, cross_encoder_score double")
    assert [r["doc"] for r in rerank.merge_intents(tops, 1).orderBy("position").collect()] == ["a", "e", "b"]
    q = spark.createDataFrame([(0,), (1,), (9,)], "query int")
    gated = {r["query"]: r.refused for r in rerank.gate(got, q, 0.1).collect()}
    assert gated == {0: False, 1: True, 9: True} and not rerank.gate(got, q, None).where("query = 1").first().refused
    loss = spark.range(1).select(rerank.ranking_loss(F.array(F.lit(0.9), F.lit(0.1), F.lit(0.2)), 20.0).alias("x")).first().x
    assert loss == pytest.approx(math.log(sum(math.exp(20 * (s - 0.9)) for s in (0.9, 0.1, 0.2))))


def test_mining(spark):
    chunks = spark.createDataFrame([(i, [f"t{i}", "x"] if i != 2 else ["t1", "x"]) for i in range(1, 12)], "doc long, terms array<string>")
    pairs = spark.createDataFrame([(0, 1, [5], [7, 99]), (1, 404, [], [])], "pair long, positive long, extra array<bigint>, manual array<bigint>")
    hits = spark.createDataFrame([(0, d, k) for k, d in enumerate([1, 2, 5, 3, 7], 1)], "pair long, doc long, rank int")
    got = mine.hard_negatives(pairs, hits, chunks, per_positive=4).orderBy("place").collect()
    assert [(r.neg, r.source) for r in got[:2]] == [(7, "manual"), (3, "bm25")] and [r.source for r in got[2:]] == ["random", "random"]
    assert not {1, 5} & {r.neg for r in got} and len({r.neg for r in got}) == 4
    assert mine.hard_negatives(pairs, hits, chunks, per_positive=4, fill=False).count() == 2


def test_random_negatives_come_from_the_whole_corpus(spark):
    chunks = spark.createDataFrame([(d, ["t%d" % d]) for d in range(300)], "doc long, terms array<string>")
    pairs = spark.createDataFrame([(p, p, [p + 1], []) for p in range(200)], "pair long, positive long, extra array<bigint>, manual array<bigint>")
    hits = spark.createDataFrame([], "pair long, doc long, rank int")
    got = mine.hard_negatives(pairs, hits, chunks, per_positive=8).collect()
    assert len(got) == len({(r.pair, r.neg) for r in got}) == 1600 and len({r.neg for r in got}) > 280
    assert not any(r.neg in (r.positive, r.positive + 1) for r in got)


def test_ids_and_sessions(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "a")], "n int, id string")
    assert [r.id for r in ids.disambiguate(df, "id", "n").orderBy("n").collect()] == ["a", "a__occ2", "b", "a__occ3"]
    t = spark.createDataFrame([("x" * 40,), ("a\nb",), ("",), (None,)], "q string").select(ids.title(F.col("q"), "new").alias("t")).collect()
    assert [r.t for r in t] == ["x" * 35 + "...", "a b", "new", "new"]
    s = ids.Sessions(spark, str(tmp_path))
    s.save("u", "c1", "one", "2024-01-01", [("user", "hi")])
    s.save("u", "c2", "two", "2024-02-01", [])
    s.save("u", "c1", "uno", "2024-03-01", [("user", "hi"), ("assistant", "yo")])
    assert [(r.conversation_id, r.title) for r in s.list("u").collect()] == [("c1", "uno"), ("c2", "two")]
    assert s.load("u", "c1").messages[1].content == "yo"
    s.delete("u", "c1")
    assert [r.conversation_id for r in s.list("u").collect()] == ["c2"] and s.list("other").count() == 0
    with pytest.raises(FileNotFoundError):
        s.load("u", "c1")


def test_containing_equals_brute_force(spark):
    from sedra.operators import contain

    rng = random.Random(12)
    texts = [" ".join(rng.choice("ab cd ef gh ij kl".split()) for _ in range(rng.randint(0, 40))).replace("ij ij", "ij\n\tij") for _ in range(60)] + [None, ""]
    passages = [t[3 : 3 + rng.randint(1, 60)] for t in texts if t and len(t) > 10][:40] + [None, "", "ab", "never in it at all, not once", " cd ef gh ij kl "]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    items = spark.createDataFrame(list(enumerate(passages)), "item_id long, text string")
    want = sorted((q, d) for q, p in enumerate(passages) if p for d, t in enumerate(texts) if t and p in t)
    assert want and sorted(map(tuple, contain.containing(docs, items).collect())) == want
    with pytest.raises(ValueError):
        contain.containing(docs, items, max_short=0)


def test_search_in_parts_equals_one_search(spark, corpus, monkeypatch):
    docs = spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(corpus)], "doc_id long, text string")
    queries = spark.createDataFrame([(i, "abcdefghij"[i % 10] + " " + "jihgf"[i % 5]) for i in range(12)] + [(99, "zz")], "query_id long, text string")
    index = bm25.build_index(docs)
    whole = sorted(map(tuple, bm25.search(index, queries, 7).collect()))
    monkeypatch.setattr(bm25, "MAX_BROADCAST_TERMS", 5)
    assert sorted(map(tuple, bm25.search(index, queries, 7).collect())) == whole
    monkeypatch.setattr(bm25, "BLOCK_QUERIES", 3)
    assert sorted(map(tuple, bm25.search(index, queries, 7).collect())) == whole and len({r[0] for r in whole}) == 13
    two = bm25.search_runs(docs, queries, [(3, bm25.Bm25()), (5, bm25.Bm25("l"))])
    assert [sorted(map(tuple, x.collect())) for x in two] == [sorted(map(tuple, bm25.search_text(docs, queries, k, m).collect())) for k, m in ((3, bm25.Bm25()), (5, bm25.Bm25("l")))]


def test_term_frequencies_are_counted_without_a_shuffle(spark, corpus):
    docs = spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(corpus)] + [(98, ""), (99, None)], "doc_id long, text string")
    tf = bm25.build_index(docs).tf
    want = sorted((i, t, n) for i, d in enumerate(corpus) for t, n in Counter(d).items())
    assert sorted(map(tuple, tf.collect())) == want
    assert "Exchange" not in tf._jdf.queryExecution().executedPlan().toString()


def test_stored_index_is_searched_without_shuffling_documents(spark, corpus, tmp_path):
    docs = spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(corpus)], "doc_id long, text string")
    queries = spark.createDataFrame([(0, "a b b"), (1, "zz")], "query_id long, text string")
    bm25.save_index(bm25.build_index(docs), str(tmp_path / "i"))
    index = bm25.load_index(spark, str(tmp_path / "i"))
    for found in (bm25.search(index, queries, 5), bm25.search(bm25.build_index(docs), queries, 5)):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and "Join" not in plan  # the k best of each partition meet by query
    assert bm25.search(index, queries.where("query_id = 1"), 5, pad_zero=False).count() == 0
    assert bm25.search(index, queries, 5, docs=docs.where("doc_id < 3").select(F.col("doc_id").alias("doc"))).count() == 6


def test_scorer_holds_few_tokens_and_postings_at_once(monkeypatch):
    import numpy as np
    import pyarrow as pa

    rng = random.Random(8)
    texts = [[rng.choice("abcdefgh") for _ in range(rng.randint(0, 30))] for _ in range(50)] + [[]]
    batch = pa.RecordBatch.from_arrays([pa.array(range(51)), pa.array([len(t) for t in texts]), pa.array(texts, pa.list_(pa.string()))], ["doc", "dl", "terms"])
    known = [{"query": q, "term": t, "qf": 1, "idf_0": 0.5 + q, "idf_1": 1.0} for q in range(9) for t in "abcdz"[q % 3 :]]
    blocks = []
    monkeypatch.setattr(bm25, "BLOCK_QUERIES", 4)
    for block in bm25._blocks(known, [20]):
        rows = sorted((r for r in known if r["query"] in block), key=lambda r: r["term"])
        terms = sorted({r["term"] for r in rows})
        first = np.cumsum([0] + [sum(r["term"] == t for r in rows) for t in terms])
        blocks.append((block, terms, first, np.array([block.index(r["query"]) for r in rows], np.int64), [np.array([r[f"idf_{i}"] for r in rows], float) for i in (0, 1)]))
    shared = type("Shared", (), {"value": blocks})
    run = lambda: sorted(tuple(r.values()) for b in bm25._scorer(shared, pa.int64(), 12.0, [(3, bm25.Bm25()), (6, bm25.Bm25("l"))], True)([batch]) for r in b.to_pylist())
    whole, seen, bincount = run(), [], np.bincount
    assert len(whole) == 10 * 9
    monkeypatch.setattr(np, "bincount", lambda x, **more: seen.append(len(x)) or bincount(x, **more))
    monkeypatch.setattr(bm25, "TOKENS_AT_ONCE", 90)
    monkeypatch.setattr(bm25, "POSTINGS_AT_ONCE", 25)
    assert run() == whole and max(seen) <= 32  # 8 terms, 4 queries: a single document can meet so many
