"""SimHash near-duplicates by pigeonhole blocks.

A fingerprint of 64 bits stands for a text. Two fingerprints that differ in 2 bits at most agree in at
least 2 of 4 blocks of 16 bits; so each fingerprint is keyed by every pair of blocks (6 masks of 32 bits),
and only fingerprints with an equal key are compared. Copies collapse first: the join runs on distinct
fingerprints. A key with more than `cap` fingerprints is not compared in pairs: its fingerprints are keyed
anew by the mask widened by a third of its free bits (3 ways, one of which must agree again), and once more
after that; then at most 2^15 distinct fingerprints can share a key, and they are linked through their
one-bit variants (two fingerprints within 2 bits share a variant). Every step is exact: no candidate is
dropped. A key gives a spanning forest of its links, so never more rows than it has members.

Null and blank texts have fingerprint zero and are linked like any other. Null ids form links, but the
smallest id of a component ignores them. Repeated rows each get their row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, partitions, ship, texts

SEED = 42
MAX_BITS = 2
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint(text: str | None, width: int = 3) -> int:
    """Unsigned; bit i is set if it is set in over half of the shingles' hashes."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes.lower() folds A-Z only
    n = len(words) - width + 1
    if not words:
        return 0
    if n <= 1:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, ends[width - 1 :].tolist())), np.uint64, n)
    octets = h.astype("<u8").view(np.uint8).reshape(n, 8)
    if n < 400:
        counts = np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    else:
        counts = np.concatenate([np.bincount(octets[:, k], minlength=256) @ _BITS for k in range(8)])
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(id, text_hash, fp): the fingerprint of the shingles of so many words, as a signed long."""
    ship(docs.sparkSession)

    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(t, width) for t in texts(b, text_col)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(fps)], [id_col, "text_hash", "fp"])

    out = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("text_hash", T.LongType()), T.StructField("fp", T.LongType())])
    return docs.select(id_col, text_col, F.xxhash64(text_col).alias("text_hash")).mapInArrow(run, out)


def _masks() -> list[list[int]]:
    """Bit masks of the three levels; the children of mask m are 3m, 3m + 1 and 3m + 2 of the next."""
    first = [(0xFFFF << (16 * i)) | (0xFFFF << (16 * j)) for i in range(4) for j in range(i)]
    levels = [first]
    for _ in range(2):
        nxt = []
        for m in levels[-1]:
            free = [1 << i for i in range(64) if not m >> i & 1]
            nxt += [m | sum(free[k::3]) for k in range(3)]
        levels.append(nxt)
    return levels


MASKS = _masks()


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the graph of n nodes with the edges (a, b)."""
    root, out = list(range(n)), []

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for x, y in zip(a.tolist(), b.tolist()):
        x, y = find(x), find(y)
        if x != y:
            root[max(x, y)] = min(x, y)
            out.append((min(x, y), max(x, y)))
    return out


def links(fps: np.ndarray) -> list[tuple[int, int]]:
    """Index pairs that span the same components as all pairs within MAX_BITS. fps: distinct uint64."""
    n = len(fps)
    if n <= 256:
        a, b = np.nonzero(np.triu(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= MAX_BITS, 1))
        return _forest(n, a, b)
    variants = np.concatenate([fps] + [fps ^ np.uint64(1 << i) for i in range(64)])
    owner = np.tile(np.arange(n), 65)
    order = np.argsort(variants, kind="stable")
    v, owner = variants[order], owner[order]
    same = v[1:] == v[:-1]
    return _forest(n, owner[:-1][same], owner[1:][same])


def _linker(cap: int | None):
    """Rows sorted by (mask, key) to links (a, b), and to the members of overfull keys (a, mask, hot)."""

    def run(batches):
        held, key, hot = [], None, False

        def flush(out):
            if hot or not held:
                return
            fps = np.unique(np.concatenate(held)).view(np.uint64) if len(held) > 1 else held[0].view(np.uint64)
            if len(fps) > 1:
                s = fps.view(np.int64)
                out += [(int(s[i]), int(s[j]), key[0], False) for i, j in links(fps)]

        def batch(rows):
            a, b, m, h = zip(*rows)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(m, pa.int32()), pa.array(h, pa.bool_())], ["a", "b", "mask", "hot"])

        for x in batches:
            if not x.num_rows:
                continue
            mask, keys, fps = (x.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            starts = np.flatnonzero(np.concatenate(([True], (mask[1:] != mask[:-1]) | (keys[1:] != keys[:-1])))).tolist()
            out: list = []
            for i, j in zip(starts, [*starts[1:], len(fps)]):
                k = (int(mask[i]), int(keys[i]))
                if k != key:
                    flush(out)
                    held, key, hot = [], k, False
                elif hot:
                    out += [(int(f), None, k[0], True) for f in fps[i:j]]
                    continue
                held.append(fps[i:j])
                if cap and sum(map(len, held)) > cap:
                    out += [(int(f), None, k[0], True) for part in held for f in part]
                    held, hot = [], True
            if out:
                yield batch(out)
        out = []
        flush(out)
        if out:
            yield batch(out)

    return run


def link_fingerprints(distinct: DataFrame, cap: int = 512) -> DataFrame:
    """Links (a, b) between the distinct longs in column fp; they span the components of all pairs within MAX_BITS."""
    ship(distinct.sparkSession)
    n = partitions(distinct.sparkSession)
    rows, found = None, None
    for level, masks in enumerate(MASKS):
        if level == 0:
            keyed = distinct.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("mask"), F.lit(_signed(m)).bitwiseAND(F.col("fp")).alias("key")) for i, m in enumerate(masks)])).alias("k")).select("k.mask", "k.key", "fp")
        else:
            lookup = F.array(*[F.lit(_signed(m)) for m in masks])
            child = F.explode(F.array(*[(F.col("mask") * 3 + k).cast("int") for k in range(3)]))
            keyed = rows.where("hot").select(F.col("a").alias("fp"), child.alias("mask")).distinct().select("mask", lookup[F.col("mask")].bitwiseAND(F.col("fp")).alias("key"), "fp")
        sorted_ = keyed.repartition(n, "mask", "key").sortWithinPartitions("mask", "key")
        rows = cut(sorted_.mapInArrow(_linker(cap if level < 2 else None), "a long, b long, mask int, hot boolean"))
        part = rows.where(~F.col("hot")).select("a", "b")
        found = part if found is None else found.unionByName(part)
        if level < 2 and not rows.where("hot").limit(1).count():
            break
    return found.distinct()


def _with_low(pairs: DataFrame, low: DataFrame, few: bool, hub: int) -> DataFrame:
    """pairs (u, v) with the m of their u; low: (u, m, n), n the pairs of u. Beyond `few`, only nodes of more than `hub` pairs are broadcast."""
    if few:
        return pairs.join(F.broadcast(low.select("u", "m")), "u")
    hubs = F.broadcast(low.where(F.col("n") > hub).select("u", F.col("m").alias("hub_m")))
    split = pairs.join(hubs, "u", "left")
    rest = split.where("hub_m is null").select("u", "v").join(low.where(F.col("n") <= hub).select("u", "m"), "u")
    return split.where("hub_m is not null").select("u", "v", F.col("hub_m").alias("m")).unionByName(rest.select("u", "v", "m"))


def components(edges: DataFrame, max_rounds: int = 60, max_broadcast: int = 20_000, hub: int = 512) -> DataFrame:
    """(node, root) for every node of the edges (a, b); the root is the component's smallest node.

    Alternating large and small stars: each round costs a few shuffles of the edges, and the number of
    rounds grows with the logarithm of the component's size. Each round is checkpointed. Up to max_broadcast edges, by a count, a node's
    smallest neighbour is broadcast to them. Of more edges, only the nodes with over `hub` of them, a 256th of the edges at most, are broadcast, so
    that no task gets all edges of one; the driver, which holds each broadcast of each round until it collects its garbage, has little to hold.
    """
    edges = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    few, print_ = edges.count() <= max_broadcast, None
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n"))
        large = _with_low(both, low, few, hub).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = _with_low(large, low, few, hub)
        edges = cut(small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == print_:
            break
        few, print_ = now[0] <= max_broadcast, now
    else:
        raise RuntimeError("the components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", cap: int = 512, width: int = 3) -> DataFrame:
    """(id, text_hash, fp, component_id, n_component, first_hash) for each row of docs.

    component_id: the smallest id reachable over links; n_component: the component's rows; first_hash: the
    text_hash of its representative, the row of the smallest (id, text_hash).
    """
    fps = cut(fingerprints(docs, id_col, text_col, width))
    each = cut(fps.groupBy("fp").agg(F.min(F.struct(F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"), "text_hash")).alias("low"), F.count("*").alias("n")))
    return labelled(fps, each, components(link_fingerprints(each.select("fp"), cap)), id_col)


def labelled(fps: DataFrame, each: DataFrame, stars: DataFrame, id_col: str) -> DataFrame:
    """The rows of fps with what near_duplicates gives; each: (fp, low, n); stars: (node, root) of linked fingerprints."""
    rooted = each.join(stars, each["fp"] == stars["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "low", "n")
    groups = rooted.groupBy("root").agg(F.min("low").alias("low"), F.sum("n").alias("n_component"))
    label = rooted.select("fp", "root").join(groups, "root").select("fp", F.col("low.id").alias("component_id"), "n_component", F.col("low.text_hash").alias("first_hash"))
    return fps.join(label, "fp").select(id_col, "text_hash", "fp", "component_id", "n_component", "first_hash")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", groups=near_duplicates) -> DataFrame:
    """docs with one row of each component, its representative; all columns stay, whatever their names. groups: gives the components."""
    ids = groups(docs, id_col, text_col)
    keys = ["id", "no_id", "hash"]  # plain keys, so that the window finds the join's partitioning
    key = lambda c, text_hash: [F.coalesce(c.cast("string"), F.lit("")).alias("id"), c.isNull().alias("no_id"), text_hash.alias("hash")]
    first = ids.where(F.col(id_col).eqNullSafe(F.col("component_id")) & (F.col("text_hash") == F.col("first_hash")))
    first = first.select(*key(F.col(id_col), F.col("text_hash"))).distinct()
    names = [f"`{c}`" for c in docs.columns]
    rows = docs.select(*key(F.col(id_col), F.xxhash64(text_col)), F.xxhash64(*names).alias("order"), F.struct(*names).alias("row"))
    once = rows.join(first, keys, "left_semi").withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy("order"))).where("n = 1")
    return once.select(*[F.col("row")[c].alias(c) for c in docs.columns])
