import random

import corpus_pipeline
import numpy as np
from sedra.llm import near_copies as n
from sedra.llm import simhash

from .test_simhash import docs


def brute_sets(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
    return {" ".join(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {" ".join(w)}


def brute_groups(texts):
    sets, root = [brute_sets(t) for t in texts], list(range(len(texts)))
    for i in range(len(sets)):
        for j in range(i):
            if 9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j])):
                a, b = root[i], root[j]
                root = [b if r == a else r for r in root]
    return {frozenset(i for i, r in enumerate(root) if r == k) for k in set(root)}


def edited(rng, text, edits):
    w = text.split()
    for _ in range(edits):
        w[rng.randrange(len(w))] = "new%d" % rng.randrange(10**9)
    return " ".join(w)


def corpus():
    """Twelve texts, each with copies of 0 to 12 changed words: similarities on both sides of 0.8, and chains."""
    rng, out = random.Random(5), [None, "", "A b", "a  B", "a b c"]
    for _ in range(12):
        base = " ".join("w%d" % rng.randrange(3000) for _ in range(200))
        out += [base, base.upper(), *[edited(rng, base, k) for k in range(1, 13)]]
        out.append(edited(rng, out[-9], 3))
    return out


def test_link_sets_equals_brute_force():
    texts = corpus()
    label = n.link_sets([n.shingles(t) for t in texts])
    assert {frozenset(i for i, r in enumerate(label) if r == k) for k in set(label)} == brute_groups(texts)


def test_stage_drops_near_copies(spark):
    texts = corpus()
    df = docs(spark, [(i, t, "en", "s", 1) for i, t in enumerate(texts)])
    want = {min(g) for g in brute_groups(texts)}
    kept = corpus_pipeline.near_duplicates(spark, df, "")
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted(want)
    shuffled = n.near_copies(df, max_broadcast=0).collect()
    assert {r.component_id for r in shuffled} == want and len(shuffled) == len(texts)
    for cap in (1, 4):  # groups dealt to several tasks
        split = n.near_copies(df, cap=cap).collect()
        assert {r.component_id for r in split} == want and len(split) == len(texts)
        by = {r.doc_id: r.component_id for r in split}
        assert all(by[i] == min(g) for g in brute_groups(texts) for i in g)


def test_shared_passages_make_no_group(spark):
    """Documents that share a long passage, but little else, are not even candidates."""
    rng = random.Random(6)
    passage = " ".join("p%d" % i for i in range(60))
    texts = [" ".join("w%d" % rng.randrange(10**6) for _ in range(200)) + " " + passage for _ in range(300)]
    df = docs(spark, [(i, t, "en", "s", 1) for i, t in enumerate(texts)])
    assert {r.component_id for r in n.near_copies(df).collect()} == set(range(300))


def test_candidates_come_from_simhash():
    """The fingerprint is the majority of the shingles' bits, and pairs of a similarity of 0.82 meet in a block and pass the Hamming check."""
    rng = random.Random(7)
    for words in (0, 1, 5, 6, 40, 700):
        text = " ".join("w%d" % rng.randrange(10**6) for _ in range(words))
        bits = n.sketch(n.shingles(text))
        assert len(bits) == n.WORDS and (not words or int(bits[0]) == simhash.fingerprint(text, 5))
    met, pairs = 0, 300
    for _ in range(pairs):
        base = " ".join("w%d" % rng.randrange(10**6) for _ in range(204))
        words = base.split()
        for i in range(10, 10 + 5 * 4, 5):  # four words apart: 20 of 200 shingles, and as many new ones
            words[i] = "x%d" % rng.randrange(10**6)
        a, b = (n.sketch(n.shingles(t)) for t in (base, " ".join(words)))
        x, y = (np.unpackbits(s.view(np.uint8), bitorder="little") for s in (a, b))
        assert np.bitwise_count(a[: n.SENT] ^ b[: n.SENT]).sum() <= n.FAR
        met += any((x[p] == y[p]).reshape(n.BLOCKS, n.BITS).all(axis=1).any() for p in n._PLACES)
    assert met == pairs


def test_link_keys_equals_brute_force():
    rng = np.random.default_rng(8)
    centres = rng.integers(0, 1 << 63, (6, n.SENT), np.uint64)
    bits = centres[rng.integers(0, 6, 300)]
    for _ in range(30):
        bits[np.arange(300), rng.integers(0, n.SENT, 300)] ^= np.uint64(1) << rng.integers(0, 63, 300, np.uint64)
    key = np.sort(rng.integers(0, 4, 300)).astype(np.uint16)

    def groups(pairs):
        label = list(range(300))
        for a, b in pairs:
            label = [label[a] if x == label[b] else x for x in label]
        return {frozenset(i for i, x in enumerate(label) if x == k) for k in set(label)}

    near = [(a, b) for a in range(300) for b in range(a) if key[a] == key[b] and np.bitwise_count(bits[a] ^ bits[b]).sum() <= n.FAR and np.bitwise_count(bits[a, 0] ^ bits[b, 0]) <= 24]
    for most in (1024, 10):
        pairs = list(zip(*n.link_keys(key, bits, most)))
        assert set(pairs) <= {p for a, b in near for p in ((a, b), (b, a))} and groups(pairs) == groups(near)


def roots(count, pairs):
    """The smallest index of each component, and how many pairs joined two of them."""
    root, joined = list(range(count)), 0
    for a, b in pairs:
        a, b = root[a], root[b]
        joined += a != b
        root = [min(a, b) if r in (a, b) else r for r in root]
    return root, joined


def chained(rng, many):
    """One text with 6 changed words in each copy: many copies are only joined by others between them."""
    base = " ".join("w%d" % rng.randrange(10**6) for _ in range(150))
    return [edited(rng, base, 6) for _ in range(many)]


def test_links_of_a_block_are_a_forest():
    """No pair joins what other pairs or the labels join already, in any way of searching, and the groups are those of brute force."""
    bits = np.stack([n.sketch(n.shingles(t))[: n.SENT] for t in chained(random.Random(9), 300)])
    key = np.sort(np.random.default_rng(9).integers(0, 3, 300)).astype(np.uint16)
    near = [(a, b) for a in range(300) for b in range(a) if key[a] == key[b] and np.bitwise_count(bits[a] ^ bits[b]).sum() <= n.FAR and np.bitwise_count(bits[a, 0] ^ bits[b, 0]) <= 24]
    some = [k - k % 3 for k in range(300)]  # three rows each go by one name
    for most in (1024, 10):
        pairs = list(zip(*n.link_keys(key, bits, most)))
        root, joined = roots(300, pairs)
        assert joined == len(pairs) and root == roots(300, near)[0]
        more = list(zip(*n.link_keys(key, bits, most, label=np.array(some))))
        root, joined = roots(300, [*enumerate(some), *more])
        assert joined == len(more) + 200 and root == roots(300, [*enumerate(some), *near])[0]


def test_links_grow_with_a_group_not_with_its_square(spark):
    """The blocks of a group of near copies give a few links for each of them, which join the group as all blocks do."""
    texts = chained(random.Random(10), 600)
    for many in (300, 600):
        each = n.sketches(docs(spark, [(i, t, "en", "s", 1) for i, t in enumerate(texts[:many])]), "doc_id", "text").select("fp", "bits").distinct()
        links, stars = n.candidates(each)
        links = links.collect()
        assert sum(r.times + r.later for r in links) <= n.HEAD * many
        assert len({r.root for r in stars.collect()}) == 1 and {r.root for r in stars.collect()} == {min(r.fp for r in each.collect())}
