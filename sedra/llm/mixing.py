"""Mixing sources to target weights, by DataFrame functions only.

The words of each source are packed into blocks of fixed length, without gaps between documents. Output shards
of a fixed number of slots draw their source counts from a multinomial distribution over the targets. What a
source draws beyond its quota is opened again, at pseudorandom places of all shards, and goes to the sources that drew too little, so
that every shard keeps its number of slots and the totals meet the quotas. A source's k-th slot is mapped through a
pseudorandom permutation of its block indices (a keyed Feistel network), another one on every pass through the
source; slots and blocks are joined by (source, index).

The block length is `block_words`; a source that would have fewer than `min_blocks` blocks has shorter ones, so that a
small source comes near its target too.

No source passes through one task: documents are dealt into buckets by a hash of their id, size and copy, and packed inside their
bucket; a bucket's place follows from running sums over buckets in two levels. Slots are dealt by shard.

Null texts and texts without words have size 0 and are never taken. A null source is a source of its own,
the last. Repeated rows are packed one after the other and get a row each. An empty table gives no rows.
Other columns, whatever their names, are not read. All draws are hashes of the seed, so reruns agree.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, partitions

#: Up to so many sources are sent to the executors; more are joined by salted keys.
MAX_BROADCAST = 10_000
CELLS, GROUP, SALTS, WALK = 4096, 1024, 64, 64


@dataclass(frozen=True)
class Mix:
    block_words: int = 256
    min_blocks: int = 1024
    shard_slots: int = 1024
    bucket_rows: int = 1000
    weights: tuple = (1, 2, 3)
    max_epochs: float = 3.0
    seed: int = 20240607


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id, source, size) for each row."""
    n = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), n.alias("size"))


def source_targets(sized: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """(source, source_size, source_rows, target, rank) of each source.

    Sources in code point order, nulls last, weigh mix.weights in turn. A source's target stops at
    max_epochs times its size, and the excess is shared anew by weight. Capped are the sources of the
    smallest cap for their weight; with sources in that order, the first k are capped if a share of what
    the first k - 1 leave would still exceed the k-th cap. All windows run over one row for each source.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("source_rows"))
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    w = F.array(*[F.lit(float(x)) for x in mix.weights])
    per = per.withColumn("rank", F.row_number().over(order) - 1).withColumn("weight", w[F.col("rank") % len(mix.weights)])
    per = per.withColumn("cap", F.col("source_size") * F.lit(float(mix.max_epochs)))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    before, whole = by_ratio.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    per = (
        per.withColumn("total", F.sum("source_size").over(whole).cast("double"))
        .withColumn("caps", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("weights", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("level", (F.col("total") - F.col("caps")) / F.col("weights"))
        .withColumn("capped", F.col("level") * F.col("weight") > F.col("cap"))
        .withColumn("free", F.min(F.when(~F.col("capped"), F.struct(F.col("cap") / F.col("weight"), "rank", "level"))).over(whole)["level"])
    )
    target = F.when(F.col("capped") | F.col("free").isNull(), F.col("cap")).otherwise(F.col("free") * F.col("weight"))
    return per.select("source", "source_size", "source_rows", target.alias("target"), "rank")


def quotas(targets: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """targets with length (words of a block), blocks, and quota: the slots that come nearest to the target.

    Whole passes through a source take all its words; what is left of the target is rounded to blocks.
    """
    want = F.greatest(F.col("source_size") / F.lit(float(mix.min_blocks)), F.lit(1.0))
    length = F.least(F.pow(F.lit(2.0), F.floor(F.log2(want))), F.lit(float(mix.block_words))).cast("long")
    out = targets.withColumn("length", length).withColumn("blocks", F.expr("(source_size + length - 1) div length"))
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + F.lit(1e-9))).otherwise(0).cast("long")
    rest = F.greatest(F.col("target") - passes * F.col("source_size"), F.lit(0.0))
    quota = passes * F.col("blocks") + F.least(F.round(rest / F.col("length")).cast("long"), F.col("blocks"))
    most = F.floor(F.col("blocks") * F.lit(float(mix.max_epochs)))
    return out.withColumn("quota", F.when(F.col("source_size") > 0, F.least(quota, most)).otherwise(0).cast("long"))


def running(df: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """df with before: the sum of value over the rows of its key with a smaller `at`; in two levels, so that no task holds a whole key."""
    df = df.withColumn("group", F.expr(f"{at} div {GROUP}"))
    sums = df.groupBy(F.col(key).alias("of"), F.col("group").alias("in")).agg(F.sum(value).alias("sum"))
    outer = Window.partitionBy("of").orderBy("in").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("of", "in", F.coalesce(F.sum("sum").over(outer), F.lit(0)).alias("base"))
    inner = Window.partitionBy(key, "group").orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    within = df.withColumn("before", F.coalesce(F.sum(value).over(inner), F.lit(0)))
    joined = within.join(sums, (F.col(key) == F.col("of")) & (F.col("group") == F.col("in")))
    return joined.withColumn("before", F.col("before") + F.col("base")).drop("of", "in", "base", "group")


def with_source(df: DataFrame, sources: DataFrame, few: bool, by: str, columns: list[str], salt: Column) -> DataFrame:
    """df with columns of its source (by: source or rank). Beyond a broadcast, sources are repeated for each salt, as one source may hold most rows."""
    right = sources.select(F.col(by).alias("__by"), *columns)
    if few:
        return df.join(F.broadcast(right), F.col(by).eqNullSafe(F.col("__by"))).drop("__by")
    right = right.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    left = df.withColumn("__of", F.pmod(salt, F.lit(SALTS)).cast("int"))
    return left.join(right, F.col(by).eqNullSafe(F.col("__by")) & (F.col("__of") == F.col("__salt"))).drop("__by", "__of", "__salt")


def packed(sized: DataFrame, sources: DataFrame, few: bool, mix: Mix) -> DataFrame:
    """(rank, id, size, n, length, start, end): the words of its source that each row with words fills; n: its place among repeated rows."""
    alike = sized.where("size > 0").groupBy("source", "id", "size").agg(F.count("*").alias("copies"))
    alike = with_source(alike, sources, few, "source", ["rank", "length", "source_rows"], F.xxhash64("id", "size"))
    # Copies are dealt in lots, so that a row repeated without end is no hot bucket.
    lots = alike.withColumn("lot", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(copies - 1) div {mix.bucket_rows}"))))
    lots = lots.withColumn("in_lot", F.least(F.col("copies") - F.col("lot") * mix.bucket_rows, F.lit(mix.bucket_rows)))
    h = F.xxhash64("id", "size", "lot", F.lit(mix.seed))
    dealt = lots.withColumn("h", h).withColumn("bucket", F.pmod("h", F.expr(f"(source_rows + {mix.bucket_rows - 1}) div {mix.bucket_rows}"))).withColumn("words", F.col("size") * F.col("in_lot"))
    w = Window.partitionBy("rank", "bucket").orderBy("h", "id", "size", "lot").rowsBetween(Window.unboundedPreceding, -1)
    dealt = dealt.withColumn("start", F.coalesce(F.sum("words").over(w), F.lit(0)))
    totals = dealt.groupBy("rank", "bucket").agg(F.sum("words").alias("total"))
    base = running(totals, "rank", "bucket", "total").select(F.col("rank").alias("r"), F.col("bucket").alias("b"), "before")
    where = dealt.join(base, (F.col("rank") == F.col("r")) & (F.col("bucket") == F.col("b")))
    each = where.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("in_lot") - 1)))
    start = F.col("before") + F.col("start") + F.col("i") * F.col("size")
    return each.select("rank", "id", "size", (F.col("lot") * mix.bucket_rows + F.col("i") + 1).alias("n"), "length", start.alias("start"), (start + F.col("size")).alias("end"))


def permuted(k: Column, n: Column, source: Column, lap: Column, seed: int) -> Column:
    """The image of k under a keyed permutation of 0 .. n - 1.

    A Feistel network over pairs (x, y) of the smallest near-square rectangle that holds n cells: each round moves one half by a
    hash of the other. An image outside is permuted again (cycle walking); fewer than sqrt(n) + 1 cells are outside.
    """
    a = F.ceil(F.sqrt(n.cast("double"))).cast("long")
    b = F.call_function("div", n + a - 1, a)

    def half(state: Column, i: Column) -> Column:
        x, y = state["x"], state["y"]
        moved = lambda own, other, n: F.pmod(own + F.pmod(F.xxhash64(F.lit(seed), source, lap, i, other), n), n)
        even = i % 2 == 0
        return F.struct(F.when(even, moved(x, y, a)).otherwise(x).alias("x"), F.when(even, y).otherwise(moved(y, x, b)).alias("y"))

    def once(v: Column) -> Column:
        start = F.struct(F.call_function("div", v, b).alias("x"), F.pmod(v, b).alias("y"))
        return F.aggregate(F.array(*[F.lit(i) for i in range(4)]), start, half, lambda s: s["x"] * b + s["y"])

    walk = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), once(k), lambda p, _: F.when(p < n, p).otherwise(once(p)))
    return F.transform(F.array(once(k)), lambda first: F.when(first < n, first).otherwise(walk))[0]


def _intervals(parts: DataFrame, width: str, total: int) -> DataFrame:
    """(rank, lo, hi, cell): the sources' parts of 0 .. total, side by side, a row for each cell they touch."""
    run = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    parts = parts.where(F.col(width) > 0).withColumn("hi", F.sum(width).over(run)).withColumn("lo", F.col("hi") - F.col(width))
    return parts.withColumn("cell", F.explode(F.sequence(_cell(F.col("lo"), total), _cell(F.col("hi") - 1, total))))


def _cell(x: Column, total: int) -> Column:
    return F.floor(x * F.lit(float(CELLS)) / F.lit(float(total))).cast("int")


def _fall(points: DataFrame, at: str, parts: DataFrame, total: int, few: bool) -> DataFrame:
    """points with the part that holds their `at`."""
    parts = F.broadcast(parts) if few else parts
    return points.withColumn("cell", _cell(F.col(at), total)).join(parts, "cell").where((F.col(at) >= F.col("lo")) & (F.col(at) < F.col("hi"))).drop("cell", "hi")


def draw_counts(sources: DataFrame, total: int, few: bool, mix: Mix) -> DataFrame:
    """(rank, shard, drawn, before): the draws of each source in each output shard, multinomial, and those of the shards before. Each slot is a hash."""
    slots = sources.sparkSession.range(total).select(F.expr(f"id div {mix.shard_slots}").alias("shard"), F.pmod(F.xxhash64(F.lit(mix.seed), F.lit("slot"), "id"), F.lit(total)).alias("r"))
    counts = _fall(slots, "r", _intervals(sources.select("rank", "quota"), "quota", total).select("rank", "lo", "hi", "cell"), total, few)
    return running(counts.groupBy("rank", "shard").agg(F.count("*").alias("drawn")), "rank", "shard", "drawn")


def dealt_slots(sources: DataFrame, total: int, few: bool, mix: Mix) -> DataFrame:
    """(rank, shard, k, blocks): the slots of each shard; the k of a source are 0 .. quota - 1, each once.

    A source's draws are numbered by a keyed permutation. Numbers from its quota on are open: numbered through over all sources and
    permuted again, they go to the sources that drew too little.
    """
    counts = cut(draw_counts(sources, total, few, mix))
    drew = counts.groupBy("rank").agg(F.sum("drawn").alias("all_drawn"))
    state = sources.join(drew.withColumnRenamed("rank", "r"), F.col("rank") == F.col("r"), "left").drop("r").withColumn("all_drawn", F.coalesce("all_drawn", F.lit(0)))
    over = F.greatest(F.col("all_drawn") - F.col("quota"), F.lit(0))
    state = state.withColumn("over", over).withColumn("under", F.greatest(F.col("quota") - F.col("all_drawn"), F.lit(0)))
    state = cut(state.withColumn("open_from", F.coalesce(F.sum("over").over(Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))))
    n_open = state.agg(F.coalesce(F.sum("over"), F.lit(0))).first()[0]
    n = partitions(sources.sparkSession)
    each = counts.repartition(n, "rank", "shard").withColumn("i", F.explode(F.sequence("before", F.col("before") + F.col("drawn") - 1)))
    each = with_source(each, state, few, "rank", ["blocks", "quota", "all_drawn", "open_from"], F.xxhash64("i"))
    each = each.withColumn("k", permuted(F.col("i"), F.col("all_drawn"), F.col("rank"), F.lit("draw"), mix.seed)).select("rank", "shard", "k", "blocks", "quota", "open_from")
    kept = each.where("k < quota").select("rank", "shard", "k", "blocks")
    if not n_open:
        return kept
    opened = each.where("k >= quota").select("shard", (F.col("open_from") + F.col("k") - F.col("quota")).alias("o"))
    opened = opened.withColumn("o", permuted(F.col("o"), F.lit(n_open), F.lit(-1), F.lit("open"), mix.seed))
    takers = _intervals(state.select("rank", "under", "blocks", "all_drawn"), "under", n_open).drop("under")
    filled = _fall(opened, "o", takers, n_open, few).select("rank", "shard", (F.col("all_drawn") + F.col("o") - F.col("lo")).alias("k"), "blocks")
    return kept.unionByName(filled)


def plan(sized: DataFrame, mix: Mix = Mix()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sources, blocks, slots).

    sources: (source, source_size, source_rows, target, rank, length, blocks, quota); blocks: (rank, block, id, size,
    n, words), a row for each document in a block; slots: (shard, rank, lap, block), the mix: a row for each slot of a shard.
    """
    sources = cut(quotas(source_targets(sized, mix), mix))
    n_sources, total = sources.agg(F.count("*"), F.coalesce(F.sum("quota"), F.lit(0))).first()
    few = n_sources <= MAX_BROADCAST
    fill = packed(sized, sources, few, mix)
    block = F.explode(F.sequence(F.expr("start div length"), F.expr("(end - 1) div length")))
    at = fill.withColumn("block", block)
    words = F.least("end", (F.col("block") + 1) * F.col("length")) - F.greatest("start", F.col("block") * F.col("length"))
    blocks = at.select("rank", "block", "id", "size", "n", words.alias("words"))
    if not total:
        zero = F.lit(0).cast("long")
        return sources, blocks, sources.select(zero.alias("shard"), "rank", zero.alias("lap"), zero.alias("block")).limit(0)
    slots = dealt_slots(sources, total, few, mix).withColumn("lap", F.expr("k div blocks"))
    index = permuted(F.expr("k % blocks"), F.col("blocks"), F.col("rank"), F.col("lap"), mix.seed)
    return sources, blocks, slots.select("shard", "rank", "lap", index.alias("block"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", mix: Mix = Mix()) -> DataFrame:
    """(id, source, size, source_size, target, taken) for each row of docs."""
    sized = cut(sizes(docs, id_col, text_col, source_col))
    sources, blocks, slots = plan(sized, mix)
    times = slots.groupBy("rank", "block").agg(F.count("*").alias("times"))
    taken = blocks.join(times, ["rank", "block"], "left").groupBy("rank", "id", "size", "n").agg(F.coalesce(F.sum(F.col("words") * F.col("times")), F.lit(0)).alias("taken"))
    few = sources.count() <= MAX_BROADCAST
    key = F.xxhash64("id", "size")
    rows = with_source(taken, sources, few, "rank", ["source", "source_size", "target"], key)
    none = with_source(sized.where("size = 0").withColumn("taken", F.lit(0).cast("long")), sources, few, "source", ["source_size", "target"], key)
    columns = [F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", "taken"]
    return rows.select(*columns).unionByName(none.select(*columns))
