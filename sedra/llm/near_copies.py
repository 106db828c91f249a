"""Near copies: documents whose sets of 5-word shingles have a Jaccard similarity of 0.8 or more.

By SimHash, as in simhash, with wider fingerprints: 512 bits, each the majority of that bit in the hashes of the shingles (the
first 64 are those of simhash.fingerprint over the set). Sets of similarity 0.8 have an angle of 27.3 degrees at most, so 15 % of their bits differ.
Pigeonhole blocks: 36 disjoint blocks of 14 bits, in each of 4 orders of the bits; fingerprints within 35 bits agree in a block of every order, a
pair of similarity 0.8 in none of the 144 with a probability of about 3e-5. Fingerprints that agree in a block are linked if they are within 66 of their first 256 bits
(a pair of similarity 0.8 is further apart with a probability of 1e-6, one of 0.2 as near with 1e-5). Every pair of a block is compared,
unless links found before join it already: of the links of a block a spanning forest stays, fewer than it has fingerprints. Since near copies agree in most
blocks, the first HEAD blocks are searched alone; in the others a fingerprint goes by the name of its component so far, and only links
between components count. So passages that many documents share make no group, and large groups are not linked anew by each block.
The components of the links are candidate groups, in which all pairs are compared exactly, whether or not they share a key: a group is a component
of the pairs that reach the similarity.

A candidate group of more than `cap` documents, or of more text than `cap_chars`, is dealt to several tasks. Each first links its part and the group's
pivots. Two documents that are both linked to the first pivot by then, directly or not, need no comparison; the others are compared, in blocks, with
all parts. So every pair that matters is compared, and no task holds more than two such parts.

Equal sets of shingles collapse first. A text of fewer than five words is one shingle; null and blank texts
have the empty one and are linked like any other. Null ids, repeated rows and ties: as in simhash.near_duplicates. An empty table has no groups.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, ship, texts
from .simhash import SEED, components, labelled

WIDTH, WORDS, SENT, FAR, PIVOTS = 5, 8, 4, 66, 8
ORDERS, BLOCKS, BITS = 4, 36, 14
TABLES, HEAD = ORDERS * BLOCKS, 12
_MULTIPLIERS = np.random.default_rng(SEED).integers(1 << 62, 1 << 63, WORDS - 1, np.uint64) * np.uint64(2) + np.uint64(1)
_P = np.uint64(0x9E3779B97F4A7C15)
_PLACES = np.stack([np.random.default_rng([SEED, k]).permutation(64 * WORDS)[: BLOCKS * BITS] for k in range(ORDERS)])
_ROW = np.dtype([("key", "<u2"), ("fp", "<i8"), ("bits", "<u8", SENT)])


def shingles(text: str | None) -> np.ndarray:
    """The different hashes of the shingles, sorted."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes.lower() folds A-Z only
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    n = len(words) - WIDTH + 1
    if n <= 1:
        return np.array([digest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    return np.unique(np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, ends[WIDTH - 1 :].tolist())), np.uint64, n))


def sketch(hashes: np.ndarray) -> np.ndarray:
    """The SimHash fingerprint of so many words: a bit is 1 if it is 1 in over half of the hashes, of which each word has its own."""
    n, counts = len(hashes), np.zeros(64 * WORDS, np.int64)
    for k in range(0, n, 255):
        part = hashes[k : k + 255, None]
        mixed = part * _MULTIPLIERS
        mixed ^= mixed >> np.uint64(32)
        mixed *= _P
        mixed ^= mixed >> np.uint64(29)
        octets = np.concatenate([part, mixed], axis=1).view(np.uint8)
        counts += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)


def sketches(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text_hash, fp, bits, size): fp is a hash of the set of shingles; bits: its fingerprint; size: the text's characters."""
    ship(docs.sparkSession)

    def run(batches):
        for b in batches:
            rows = texts(b, text_col)
            sets = [shingles(t) for t in rows]
            fps = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64)
            bits = pa.array([sketch(s).tobytes() for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(fps), bits, pa.array([len(t or "") for t in rows], pa.int64())], [id_col, "text_hash", "fp", "bits", "size"])

    more = [T.StructField("bits", T.BinaryType()), T.StructField("size", T.LongType())]
    out = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("text_hash", T.LongType()), T.StructField("fp", T.LongType()), *more])
    return docs.select(id_col, text_col, F.xxhash64(text_col).alias("text_hash")).mapInArrow(run, out)


def _blocks(shares: int, tables: range):
    """Rows (fp, bits) to (bucket, packed rows of _ROW): a bucket is a block of an order, one of `tables`, and one of so many shares of its values."""

    def run(batches):
        for x in batches:
            n = x.num_rows
            if not n:
                continue
            words = np.frombuffer(b"".join(x.column(1).to_pylist()), np.uint64).reshape(n, WORDS)
            every = np.unpackbits(words.view(np.uint8), axis=1, bitorder="little")
            rows = np.empty(n, _ROW)
            rows["fp"], rows["bits"] = x.column(0).to_numpy(zero_copy_only=False), words[:, :SENT]
            for k, places in enumerate(_PLACES):
                mine = [j for j in range(BLOCKS) if k * BLOCKS + j in tables]
                if not mine:
                    continue
                wide = np.zeros((n, BLOCKS, 16), np.uint8)
                wide[:, :, :BITS] = every[:, places].reshape(n, BLOCKS, BITS)
                keys = np.packbits(wide, axis=2, bitorder="little").reshape(n, BLOCKS * 2).view("<u2")
                buckets, packed = [], []
                for j in mine:
                    rows["key"] = keys[:, j]
                    share = keys[:, j] % shares
                    order = np.argsort(share, kind="stable")
                    ends = np.searchsorted(share[order], np.arange(shares + 1))
                    for i in np.flatnonzero(np.diff(ends)).tolist():
                        buckets.append((k * BLOCKS + j) * shares + i)
                        packed.append(rows[order[ends[i] : ends[i + 1]]].tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(buckets, pa.int32()), pa.array(packed, pa.binary())], ["bucket", "packed"])

    return run


def link_keys(key: np.ndarray, bits: np.ndarray, most: int = 1024, label: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs: a spanning forest of the components of all pairs of an equal key within FAR bits. key: sorted.

    label: for each row the index of the first row that it is joined to from the start; without it each is alone. A pair joins two components
    that neither the labels nor the other pairs join, so there are fewer pairs than labels.
    First the first of each key meets all others of its key, then each row the next, the next but one, and so on, where they are not yet joined. Keys of
    more than `most` rows are searched from row to row instead, among those that are not yet reached.
    """
    n = len(key)
    starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if n else np.zeros(0, np.int64)
    runs = np.diff(np.append(starts, n))
    first, out, word = np.repeat(starts, runs), [], np.ascontiguousarray(bits[:, 0])
    label = np.arange(n) if label is None else label.copy()

    def near(a, b):
        """Of the pairs (a, b) those within FAR; the first word alone rules out most (over 24 of 64 bits: 1e-6 at a similarity of 0.8)."""
        good = np.bitwise_count(word[a] ^ word[b]) <= 24
        a, b = a[good], b[good]
        good = np.bitwise_count(bits[a] ^ bits[b]).sum(axis=1, dtype=np.int64) <= FAR
        return a[good], b[good]

    small = np.repeat(runs <= most, runs)
    step, here = 0, np.flatnonzero(small & (np.arange(n) > first))
    while len(here):
        other = first[here] if step == 0 else here - step
        apart = label[here] != label[other]
        a, b = near(other[apart], here[apart])
        while len(a):
            # Each component takes one pair to a lower one, so that no pairs make a circle.
            low, high = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
            high, one = np.unique(high, return_index=True)
            out.append((a[one], b[one]))
            label[high] = low[one]
            while (label != label[label]).any():
                label = label[label]
            apart = label[a] != label[b]
            a, b = a[apart], b[apart]
        step += 1
        here = here[here - step >= first[here]]
    for s, run in zip(starts[runs > most].tolist(), runs[runs > most].tolist()):
        left = np.arange(s, s + run)
        while len(left):
            root = label[left[0]]
            mine, reached = label[left] == root, [np.zeros(0, np.int64)]
            queue, left = left[mine], left[~mine]
            while len(queue) and len(left):
                if len(queue) > len(left):  # all of the queue meets one after the other of the few that are left
                    found, queue = [near(queue, np.full(len(queue), y)) for y in left.tolist()], queue[:0]
                    a, hit = (np.concatenate([f[i][:1] for f in found]) for i in (0, 1))
                else:
                    a, hit = near(np.full(len(left), queue[-1]), left)
                    queue = queue[:-1]
                if len(hit):
                    roots, one = np.unique(label[hit], return_index=True)
                    out.append((a[one], hit[one]))
                    reached.append(roots)
                    joined = np.isin(label[left], roots)
                    queue, left = np.concatenate([queue, left[joined]]), left[~joined]
            label[np.concatenate(reached)] = root
            label = label[label]
    none = np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (none, none)


def _near_keys(bucket: pa.Table) -> pa.Table:
    rows = np.frombuffer(b"".join(bucket.column("packed").to_pylist()), _ROW)
    rows = rows[np.lexsort((rows["fp"], rows["key"]))]
    fps = np.ascontiguousarray(rows["fp"])
    _, start, which = np.unique(fps, return_index=True, return_inverse=True)  # rows of one name are joined
    a, b = link_keys(np.ascontiguousarray(rows["key"]), np.ascontiguousarray(rows["bits"]), label=start[which])
    return pa.table({"a": pa.array(fps[a], pa.int64()), "b": pa.array(fps[b], pa.int64())})


def _block_links(named: DataFrame, shares: int, tables: range) -> DataFrame:
    """(a, b, times): links between the names in fp that these blocks show, and how many of them show each."""
    keyed = named.select("fp", "bits").mapInArrow(_blocks(shares, tables), "bucket int, packed binary")
    return cut(keyed.groupBy("bucket").applyInArrow(_near_keys, "a long, b long").groupBy("a", "b").agg(F.count("*").alias("times")))


def candidates(each: DataFrame, share: int = 1 << 16) -> tuple[DataFrame, DataFrame]:
    """For distinct fp with their bits, links (a, b, times, later) that span the candidate groups, and (node, root) of the groups.

    times: the first blocks that show the link; later: the other blocks that do, where a and b are the smallest fingerprints of what the first blocks join.
    """
    shares = min(1 << BITS, each.count() // share + 1)
    head = _block_links(each, shares, range(HEAD))
    stars = components(head)
    named = each.join(stars, each["fp"] == stars["node"], "left").select(F.coalesce("root", "fp").alias("fp"), "bits")
    tail = _block_links(named, shares, range(HEAD, TABLES))
    none = F.lit(0).cast("long")
    links = head.select("a", "b", "times", none.alias("later")).unionByName(tail.select("a", "b", none.alias("times"), F.col("times").alias("later")))
    return links, components(stars.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(tail.select("a", "b")))


def link_sets(sets: list[np.ndarray]) -> list[int]:
    """The component of each set over all pairs of a similarity of 0.8 or more, by the index of one member.

    Two such sets share one of the rarest fifth of either's members, and one more (the prefix). The search
    goes from set to set and looks only at those not yet reached.
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    ends = np.cumsum(sizes)
    _, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(counts), np.int64)
    rank[np.argsort(counts, kind="stable")] = np.arange(len(counts))
    members = [np.sort(x) for x in np.split(rank[inverse], ends[:-1])]
    prefixes = [m[: len(m) - (4 * len(m) + 4) // 5 + 1] for m in members]
    flat = np.concatenate(prefixes)
    order = np.argsort(flat, kind="stable")
    owner = np.repeat(np.arange(n), [len(p) for p in prefixes])[order]
    token, first = np.unique(flat[order], return_index=True)
    posting = dict(zip(token.tolist(), np.split(owner, first[1:])))
    left, mark, label = np.ones(n, bool), np.zeros(len(counts), bool), list(range(n))
    for start in range(n):
        if not left[start]:
            continue
        left[start] = False
        queue = [start]
        while queue:
            x = queue.pop()
            near = []
            for t in prefixes[x].tolist():
                p = posting[t]
                if len(p):
                    posting[t] = p = p[left[p]]
                    near.append(p)
            near = np.unique(np.concatenate(near)) if near else np.zeros(0, np.int64)
            near = near[(5 * sizes[near] >= 4 * sizes[x]) & (4 * sizes[near] <= 5 * sizes[x])]
            mark[members[x]] = True
            for y in near.tolist():
                if 9 * int(mark[members[y]].sum()) >= 4 * int(sizes[x] + sizes[y]):
                    left[y], label[y] = False, start
                    queue.append(y)
            mark[members[x]] = False
    return label


def _linked(group: pa.Table) -> pa.Table:
    sets = {}
    for fp, t in zip(group.column("fp").to_pylist(), group.column("body").to_pylist()):
        if fp not in sets:
            sets[fp] = shingles(t)
    fps = sorted(sets)
    label = link_sets([sets[f] for f in fps])
    return pa.table({"node": pa.array(fps, pa.int64()), "root": pa.array([fps[k] for k in label], pa.int64())})


def _part(fp, n):
    return F.pmod(F.xxhash64(fp, F.lit(SEED)), n)


def _upto(n):
    return F.explode(F.sequence(F.lit(0).cast("long"), n - 1))


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_broadcast: int = 50_000, cap: int = 128, cap_chars: int = 1 << 21, share: int = 1 << 16) -> DataFrame:
    """(id, text_hash, fp, component_id, n_component, first_hash) for each row of docs, as simhash.near_duplicates gives.

    Up to max_broadcast candidates, by a count, go to the executors; more are joined by a shuffle of docs. A task compares about `share` fingerprints by one block at a time.
    """
    rows = cut(sketches(docs, id_col, text_col))
    firsts = [F.first(c).alias(c) for c in ("bits", "size")]
    each = cut(rows.groupBy("fp").agg(F.min(F.struct(F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"), "text_hash")).alias("low"), F.count("*").alias("n"), *firsts))
    links, stars = candidates(each, share)
    members = stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())
    members = members.join(each, members["node"] == each["fp"]).select("fp", F.col("root").alias("__root"), F.col("low.id").alias("__id"), F.col("low.text_hash").alias("__hash"), "size")
    groups = members.groupBy("__root").agg(F.count("*").alias("many"), F.sum("size").alias("chars"))
    parts = F.greatest(F.ceil(F.col("many") / cap), F.ceil(F.col("chars") / cap_chars)).cast("long")
    members = cut(members.join(groups.select("__root", parts.alias("parts")), "__root").withColumn("part", _part(F.col("fp"), F.col("parts"))))
    few = members.count() <= max_broadcast
    bodies = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("body"), F.xxhash64(text_col).alias("hash"))
    same = (bodies["hash"] == members["__hash"]) & bodies["id"].eqNullSafe(members["__id"])
    bodies = bodies.join(F.broadcast(members.drop("size")) if few else members, same).select("__root", "fp", "body", "parts", "part")
    if not members.where("parts > 1").limit(1).count():
        linked = cut(bodies.groupBy("__root").applyInArrow(_linked, "node long, root long"))
        return labelled(rows.select(id_col, "text_hash", "fp"), each.select("fp", "low", "n"), linked, id_col)
    bodies = cut(bodies.select("*", (F.col("parts") > 1).alias("split")))
    # The pivots of a split group are the documents that most others were linked to; the first of them names the group's main component.
    # Links of later blocks are between components, so those of the first blocks come before them.
    degree = links.groupBy(F.col("a").alias("fp")).agg(F.sum("times").alias("times"), F.sum("later").alias("later")).join(members.where("parts > 1").select("fp", "__root"), "fp")
    ranked = degree.withColumn("k", F.row_number().over(Window.partitionBy("__root").orderBy(F.desc("times"), F.desc("later"), "fp")))
    ranked = cut(ranked.where(F.col("k") <= PIVOTS).select(F.col("__root").alias("r"), F.col("fp").alias("pivot"), "k"))
    pivots = bodies.join(ranked, (bodies["__root"] == ranked["r"]) & (bodies["fp"] == ranked["pivot"])).select(bodies["__root"], "fp", "body", _upto(F.col("parts")).alias("part"))
    pivot = ranked.where("k = 1").select(F.col("r").alias("__root"), "pivot")
    first = bodies.select("__root", "fp", "body", "part").unionByName(pivots)
    linked = cut(first.groupBy("__root", "part").applyInArrow(_linked, "node long, root long"))
    found = components(linked.select(F.col("node").alias("a"), F.col("root").alias("b")))
    reach = members.where("parts > 1").join(found, members["fp"] == found["node"], "left").select("fp", "__root", F.coalesce("root", "fp").alias("c")).join(pivot, "__root")
    main = reach.where("fp = pivot").select(F.col("__root").alias("r"), F.col("c").alias("main"))
    rest = cut(reach.join(main, F.col("__root") == F.col("r")).where("c <> main").select("__root", "fp"))
    sizes = rest.groupBy("__root").agg(F.ceil(F.count("*") / cap).cast("long").alias("blocks"))
    left = bodies.where("split").join(sizes, "__root")
    asked = left.join(rest.withColumnRenamed("__root", "of"), "fp", "left_semi").withColumn("block", _part(F.col("fp"), F.col("blocks")))
    pairs = left.select("__root", "fp", "body", "part", _upto(F.col("blocks")).alias("block")).unionByName(asked.select("__root", "fp", "body", _upto(F.col("parts")).alias("part"), "block"))
    more = pairs.groupBy("__root", "part", "block").applyInArrow(_linked, "node long, root long")
    every = components(linked.unionByName(more).select(F.col("node").alias("a"), F.col("root").alias("b")))
    return labelled(rows.select(id_col, "text_hash", "fp"), each.select("fp", "low", "n"), every, id_col)
