import random
import re

import numpy as np
import xxhash

from sedra.llm import simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def brute_fingerprint(text):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    sh = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute_components(fps):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 2:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_fingerprint_equals_brute_force():
    rng = random.Random(1)
    texts = [None, "", " \t\n", "One", "a b", "a b c", "É A b c d", "x " * 900]
    texts += [" ".join(rng.choice(["the", "Of", "ß", "ça", "x1", "ÄB"]) for _ in range(rng.randint(1, 600))) for _ in range(40)]
    for t in texts:
        assert simhash.fingerprint(t) == brute_fingerprint(t), t


def test_links_span_the_same_components():
    rng = random.Random(2)
    for n in (2, 30, 700):
        base = [rng.getrandbits(64) for _ in range(max(1, n // 20))]
        fps = set()
        while len(fps) < n:
            f = rng.choice(base)
            for _ in range(rng.randint(0, 6)):
                f ^= 1 << rng.randrange(64)
            fps.add(f)
        fps = sorted(fps)
        want = brute_components(fps)
        root = list(range(n))

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in simhash.links(np.array(fps, np.uint64)):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
        assert [find(i) for i in range(n)] == want


def test_link_fingerprints_with_a_small_cap_loses_nothing(spark):
    """Overfull keys go down all three levels."""
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(5)]
    fps = {b for b in base}
    while len(fps) < 400:
        f = rng.choice(base[:2])
        for _ in range(rng.randint(1, 4)):
            f ^= 1 << rng.randrange(12)  # all differ in the lowest bits only
        fps.add(f)
    fps = sorted(fps)
    want = brute_components(fps)
    df = spark.createDataFrame([(simhash._signed(f),) for f in fps], "fp long")
    stars = {r.node: r.root for r in simhash.components(simhash.link_fingerprints(df, cap=4)).collect()}
    mine = [stars.get(simhash._signed(f), simhash._signed(f)) for f in fps]
    groups = {}
    for m, w in zip(mine, want):
        assert groups.setdefault(m, w) == w
    assert len(groups) == len(set(want))


def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_components_and_keep_one(spark):
    rng = random.Random(4)
    long = " ".join("w%d" % rng.randrange(500) for _ in range(300))
    rows = [(5, long), (3, long), (9, long + " tail"), (7, None), (8, ""), (None, long), (1, "a single line"), (1, "a single line"), (2, "quite another text here")]
    df = docs(spark, [(i, t, "en", "s", 1) for i, t in rows])
    got = simhash.near_duplicates(df).collect()
    assert len(got) == len(rows)
    fps = [brute_fingerprint(t) for _, t in rows]
    comp = brute_components(fps)
    low = {c: min([r[0] for r, k in zip(rows, comp) if k == c and r[0] is not None], default=None) for c in set(comp)}
    want = sorted((str(r[0]), fps[i], low[comp[i]]) for i, r in enumerate(rows))
    assert sorted((str(r.doc_id), r.fp % 2**64, r.component_id) for r in got) == want
    kept = simhash.keep_one(df).collect()
    assert len(kept) == len(set(comp))
    assert {r.doc_id for r in kept} == set(low.values())


def test_empty_table_and_extra_columns(spark):
    df = spark.createDataFrame([], SCHEMA + ", fp string, n int")
    assert simhash.near_duplicates(df).count() == 0
    assert simhash.keep_one(df).columns == df.columns
    one = spark.createDataFrame([(1, "x y z", "en", "s", 5, "clash", 3, "r")], SCHEMA + ", fp string, n int, root string")
    assert simhash.near_duplicates(one).count() == 1
    assert [tuple(r) for r in simhash.keep_one(one).collect()] == [(1, "x y z", "en", "s", 5, "clash", 3, "r")]


def test_many_edges_send_little_to_the_driver(spark, monkeypatch):
    """Beyond a few thousand edges only the nodes of very many edges are broadcast; before, all nodes of up to 200,000 edges were, in every round."""
    sent, real = [], simhash.F.broadcast
    monkeypatch.setattr(simhash.F, "broadcast", lambda df: sent.append(df.count()) or real(df))
    pairs = [(10**6 + 2 * i, 10**6 + 2 * i + 1) for i in range(21_000)]
    star, chain = [(5, 10_000 + i) for i in range(2_000)], [(100 + i, 101 + i) for i in range(12)]
    found = {r.node: r.root for r in simhash.components(spark.createDataFrame(pairs + star + chain, "a long, b long")).collect()}
    want = {b: a for a, b in pairs} | {b: 5 for _, b in star} | {b: 100 for _, b in chain}
    assert {k: v for k, v in found.items() if k != v} == want
    assert sum(sent) <= 100
