import re
from collections import defaultdict

from sedra.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, taken int"


def brute_targets(size_of, weights=(1, 2, 3), most=3):
    names = sorted(size_of, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, target, capped = sum(size_of.values()), {}, {}
    while True:
        free = [s for s in names if s not in capped]
        rest = total - sum(capped.values())
        target = {s: rest * w[s] / max(1, sum(w[x] for x in free)) for s in free}
        over = [s for s in free if target[s] > most * size_of[s]]
        if not over:
            return target | capped
        capped |= {s: most * size_of[s] for s in over}


def corpus(spark):
    rows = []
    for i in range(900):
        source = "src%d" % (i % 7) if i % 3 else "hot"
        if i % 50 == 7:
            source = None
        if source == "src1" and i % 5:
            source = "hot"
        text = " ".join("w%d" % (j % 9) for j in range((i * 37) % 190))
        rows.append((i, text, "en", source, len(text), "x", 1))
    rows += [(5000, None, None, "none", None, None, None), (5001, " \n", "en", "none", 2, "x", 1), (None, "a b c", None, None, 5, None, 2)]
    rows += [(6000, "same words here", "en", "tiny", 15, "x", 1)] * 4
    return rows, spark.createDataFrame(rows, SCHEMA)


def test_targets_taken_and_reruns(spark):
    rows, df = corpus(spark)
    got = mixing.mixed(df).collect()
    assert len(got) == len(rows)
    size_of = defaultdict(int)
    for r in rows:
        size_of[r[3]] += len(WORD.findall(r[1] or ""))
    want = brute_targets(size_of)
    assert sorted((str(r.doc_id), r.size) for r in got) == sorted((str(r[0]), len(WORD.findall(r[1] or ""))) for r in rows)
    taken = defaultdict(int)
    for r in got:
        assert r.source_size == size_of[r.source]
        assert abs(r.target - want[r.source]) < 1e-6 * (1 + want[r.source])
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    for s, t in want.items():
        assert abs(taken[s] - t) <= 0.03 * t + 3 * mixing.Mix().block_words, (s, taken[s], t)
    again = mixing.mixed(df.repartition(3)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_permutation_is_one_to_one(spark):
    from pyspark.sql import functions as F

    for n in (1, 2, 3, 64, 997, 5000):
        p = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n), F.lit("s"), F.lit(1), 7).alias("p"))
        assert sorted(r.p for r in p.collect()) == list(range(n))


def test_slots_match_quotas_and_blocks(spark):
    _, df = corpus(spark)
    mix = mixing.Mix(block_words=8, shard_slots=64)
    sources, blocks, slots = mixing.plan(mixing.sizes(df), mix)
    quota = {r["rank"]: (r.quota, r.blocks) for r in sources.collect()}
    seen = defaultdict(list)
    for r in slots.collect():
        seen[r["rank"]].append((r.lap, r.block))
    for k, (q, n) in quota.items():
        assert len(seen[k]) == q and len(set(seen[k])) == q and all(0 <= b < n for _, b in seen[k])
    words = defaultdict(int)
    for r in blocks.collect():
        words[r["rank"], r.block] += r.words
    assert max(words.values()) <= 8
    assert {k: len([1 for x in words if x[0] == k]) for k in quota if quota[k][1]} == {k: n for k, (_, n) in quota.items() if n}


def test_empty_and_wordless(spark):
    assert mixing.mixed(spark.createDataFrame([], SCHEMA)).count() == 0
    blank = spark.createDataFrame([(1, None, None, None, None, None, None), (2, "", "en", "a", 0, "", 0)], SCHEMA)
    assert sorted((r.doc_id, r.size, r.target, r.taken) for r in mixing.mixed(blank).collect()) == [(1, 0, 0.0, 0), (2, 0, 0.0, 0)]
