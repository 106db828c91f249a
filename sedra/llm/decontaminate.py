"""Benchmark decontamination by template canonicalisation.

Words are stripped of punctuation and case. Numbers, names (title-case words inside a sentence) and units
(unit words after a number) become typed placeholders, and every window of five such tokens with two
literal words at least is hashed. What is a name depends on case and punctuation, so every window is hashed as
plain words too, under other hashes. Windows of documents and benchmark items are joined on the hash. For a
document and an item, matches on the same diagonal are one alignment; its slots are consistent if they hold one
value of the document for each value of the item. Consistent alignments on near diagonals whose values agree
are chained, and the item is found if a chain covers 0.8 of the tokens that its template windows reach, or of all
its tokens if it has none. Windows whose slots hold the item's own values, and plain ones, count even where others
contradict.

Where the benchmark has at most `max_filter` windows, their hashes and words go to the executors, so that
only windows that occur in the benchmark are shuffled; beyond that, all windows of the documents are.

Null and empty texts have no windows. Items of fewer than five tokens have none either and are never found.
Documents are known by their id and a hash of their text: rows that repeat both count as one document, texts that share an id, or
have none, are judged each.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, ship, texts

WIDTH, SIMILARITY, MIN_LITERALS, DIAGONAL = 5, 0.8, 2, 64
UNITS = frozenset(
    """mm cm m km in inch inches ft foot feet yd yard yards mile miles mg g kg t lb lbs oz pound pounds ton tons gram grams
    ml l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hour hours day days week weeks
    month months year years hz khz mhz ghz w kw mw v volt volts a amp amps j kj cal kcal c f k degree degrees percent
    meter meters metre metres kilometer kilometers kilometre kilometres kilogram kilograms dollar dollars euro euros cent
    cents usd eur gbp byte bytes kb mb gb tb""".split()
)
_TITLE, _END, _NUM, _UNIT, _BLANK, _FLAGS = 1, 2, 4, 8, 16, 5
_NUMBER, _NAME, _MEASURE = 1, 2, 3
_P, _PLAIN = np.uint64(0x9E3779B97F4A7C15), 0x5851F42D4C957F2D
_NON_WORD = re.compile(r"[\W_]+")
_EDGES = ".,;:!?\"'()[]{}*#$%&|<>-–—…“”‘’«»¿¡/\\+=~^`@_"


def core(raw: str) -> str:
    word = raw.strip(_EDGES)
    return (word if word.isalnum() else _NON_WORD.sub("", word)).lower()


class Tokens(dict):
    """Raw word to its flags and the hash of its core; with a vocabulary, words outside it have hash 0."""

    def __init__(self, vocabulary: dict | None = None, most: int = 300_000):
        super().__init__()
        self.vocabulary, self.most = vocabulary, most

    def __missing__(self, raw: str) -> int:
        if len(self) >= self.most:
            self.clear()
        bare = raw.strip(_EDGES)
        flags = _TITLE if bare[:1].isupper() and bare[1:2].islower() else 0
        if bare.isalpha():
            word = bare.lower()
        else:
            word = core(raw)
            if not word:
                flags = _BLANK
            elif any(map(str.isdigit, word)):
                flags = _NUM
        if word in UNITS:
            flags |= _UNIT
        if raw[-1] in ".!?:…" or raw[-2:-1] in ".!?":
            flags |= _END
        if self.vocabulary is None:
            h = xxhash.xxh3_64_intdigest(word) >> _FLAGS | 4
        else:
            h = self.vocabulary.get(word, 0)
        value = (h << _FLAGS | flags) & 0xFFFFFFFFFFFFFFFF
        if len(raw) <= 40:
            self[raw] = value
        return value


def _hashes(ids: np.ndarray, alive: np.ndarray, salt: int = 0) -> np.ndarray:
    """Hashes of the windows that start at the places alive."""
    h = np.full(len(alive), salt, np.uint64)
    for k in range(WIDTH):
        h = (h + ids[alive + k]) * _P
        h ^= h >> np.uint64(29)
    return h


def _window_sums(x: np.ndarray) -> np.ndarray:
    total = np.zeros(len(x) + 1, np.int32)
    np.cumsum(x, out=total[1:])
    return total[WIDTH:] - total[:-WIDTH]


def windows(text: str | None, tokens: Tokens):
    """(words, place of each token among them, kinds: 0 literal, hashes of template windows, their places, hashes of plain windows, their places)."""
    words = text.split() if text else []
    if len(words) < WIDTH:
        return words, None, None, None, None, None, None
    packed = np.fromiter(map(tokens.__getitem__, words), np.uint64, len(words))
    flags = (packed & np.uint64((1 << _FLAGS) - 1)).astype(np.uint8)
    start = np.ones(len(words), bool)
    start[1:] = (flags[:-1] & _END) != 0
    number = (flags & _NUM) != 0
    after = np.zeros(len(words), bool)
    after[1:] = number[:-1]
    kind = np.where(number, _NUMBER, np.where(((flags & _UNIT) != 0) & after, _MEASURE, np.where(((flags & _TITLE) != 0) & ~start, _NAME, 0))).astype(np.uint8)
    at = np.flatnonzero((flags & _BLANK) == 0)
    if len(at) < WIDTH:
        return words, None, None, None, None, None, None
    kind = kind[at]
    plain = packed[at] >> np.uint64(_FLAGS)
    unknown, literal = plain == 0, kind == 0
    p = np.flatnonzero((_window_sums(literal) >= MIN_LITERALS) & (_window_sums(unknown & literal) == 0))
    q = np.flatnonzero(_window_sums(unknown) == 0)
    return words, at, kind, _hashes(np.where(literal, plain, kind.astype(np.uint64)), p), p, _hashes(plain, q, _PLAIN), q


def _slots(words, at, kind, p: int) -> list[str]:
    return [core(words[at[p + k]]) for k in range(WIDTH) if kind[p + k]]


def _template_rows(id_col: str, text_col: str, known=None, items: bool = False):
    """mapInArrow function: (id, h, pos, slots) of the windows, slots null for plain ones; of items also the words."""
    names = [id_col, "h", "pos", "slots"] + ["words"] * items

    def run(batches):
        vocabulary, hashes = known.value if known is not None else (None, None)
        tokens = Tokens(vocabulary)
        if hashes is not None:
            table = np.zeros(1 << 20, bool)
            table[(hashes & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        for b in batches:
            at_row, hs, pos, slots, cores = [], [], [], [], []
            for i, t in enumerate(texts(b, text_col)):
                words, at, kind, *both = windows(t, tokens)
                if at is None:
                    continue
                for plain, h, p in ((False, *both[:2]), (True, *both[2:])):
                    if hashes is not None and len(p):
                        few = table[(h & np.uint64((1 << 20) - 1)).astype(np.int64)]
                        h, p = h[few], p[few]
                        if len(p):
                            few = hashes[np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)] == h
                            h, p = h[few], p[few]
                    for x, k in zip(h.view(np.int64).tolist(), p.tolist()):
                        at_row.append(i)
                        hs.append(x)
                        pos.append(k)
                        slots.append(None if plain else _slots(words, at, kind, k))
                        if items:
                            cores.append([core(words[at[k + j]]) for j in range(WIDTH)])
            arrays = [b.column(0).take(pa.array(at_row, pa.int64())), pa.array(hs, pa.int64()), pa.array(pos, pa.int64()), pa.array(slots, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(arrays + [pa.array(cores, pa.list_(pa.string()))] * items, names)

    return run


def _schema(id_field: T.StructField, id_name: str, items: bool) -> T.StructType:
    strings = T.ArrayType(T.StringType())
    fields = [T.StructField(id_name, id_field.dataType), T.StructField("h", T.LongType()), T.StructField("pos", T.LongType()), T.StructField("slots", strings)]
    return T.StructType(fields + [T.StructField("words", strings)] * items)


def _bits(places) -> int:
    """The tokens that windows at these places cover, as the bits of a number."""
    out = 0
    for p in places:
        out |= ((1 << WIDTH) - 1) << p
    return out


def best_chain(diagonals: list[dict], reach: int) -> tuple[float, bool] | None:
    """(coverage, reparameterised) of the item's best alignment, or None if none covers enough.

    A diagonal is one alignment of the item. From each, the others within DIAGONAL are added, the larger first,
    whose slots agree among themselves and with those added before. Of the rest only windows with the item's
    own values count, and apart from the chain.
    """
    rows = []
    for x in sorted(diagonals, key=lambda x: x["d"]):
        slots: dict | None = {}
        for pair in x["pairs"]:
            if slots.setdefault(pair["a"], pair["b"]) != pair["b"]:
                slots = None
                break
        rows.append((x["d"], _bits(x["places"]) & reach, _bits(x["same"]) & reach, slots))
    at, length, best, other = [r[0] for r in rows], reach.bit_count(), 0, True
    for d, cover, same, slots in rows:
        near = rows[bisect_left(at, d - DIAGONAL) : bisect_right(at, d + DIAGONAL)]
        every = 0
        for r in near:
            every |= r[1]
        if every.bit_count() < SIMILARITY * length:
            continue
        for r in near:
            same |= r[2]
        chain = 0
        if slots is not None:
            chain, agreed = cover, dict(slots)
            for r in sorted(near, key=lambda r: (-r[1].bit_count(), abs(r[0] - d))):
                if r[3] is not None and all(agreed.get(a, b) == b for a, b in r[3].items()):
                    agreed.update(r[3])
                    chain |= r[1]
        most = max(chain.bit_count(), same.bit_count())
        if most >= SIMILARITY * length:
            best, other = max(best, most), other and same.bit_count() < most
    return (best / length, other) if best else None


def _judge(batches):
    for b in batches:
        rows = []
        for k, (diagonals, reach) in enumerate(zip(texts(b, "diagonals"), texts(b, "reach"))):
            if chain := best_chain(diagonals, _bits(reach)):
                rows.append((k, *chain))
        taken = pa.array([r[0] for r in rows], pa.int64())
        values = [pa.array([r[1] for r in rows], pa.float64()), pa.array([r[2] for r in rows], pa.bool_())]
        yield pa.RecordBatch.from_arrays([b.column(0).take(taken), b.column(1).take(taken), *values], ["doc", "item", "coverage", "reparameterised"])


def leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", max_filter: int = 1_000_000) -> DataFrame:
    """(id, item_id, coverage, reparameterised): the items that each document contains."""
    found = _leaks(docs, items, id_col, text_col, item_id, item_text, max_filter)
    return found.select(F.col("doc.id").alias(id_col), F.col("item").alias(item_id), "coverage", "reparameterised")


def _leaks(docs: DataFrame, items: DataFrame, id_col: str, text_col: str, item_id: str = "item_id", item_text: str = "text", max_filter: int = 1_000_000) -> DataFrame:
    """(doc, item, coverage, reparameterised); doc: (id, h), h a hash of the text."""
    spark = docs.sparkSession
    ship(spark)
    of_items = items.select(F.col(item_id).alias("item"), F.col(item_text).alias("body")).mapInArrow(_template_rows("item", "body", items=True), _schema(items.schema[item_id], "item", True))
    of_items = cut(of_items)
    reach = of_items.groupBy("item").agg(F.collect_set(F.when(F.col("slots").isNotNull(), F.col("pos"))).alias("reach"), F.collect_set("pos").alias("all"))
    reach = reach.select("item", F.when(F.size("reach") > 0, F.col("reach")).otherwise(F.col("all")).alias("reach"))
    known = None
    if of_items.count() <= max_filter:
        hashes = np.unique(np.array([r.h for r in of_items.select("h").distinct().collect()], np.int64).view(np.uint64))
        vocabulary = {r.w: xxhash.xxh3_64_intdigest(r.w) >> _FLAGS | 4 for r in of_items.select(F.explode("words").alias("w")).distinct().collect()}
        known = spark.sparkContext.broadcast((vocabulary, hashes))
    rows = docs.select(F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h")).alias("doc"), F.col(text_col).alias("body"))
    of_docs = rows.mapInArrow(_template_rows("doc", "body", known), _schema(rows.schema["doc"], "doc", False))
    right = of_items.select("item", "h", F.col("pos").alias("item_pos"), F.col("slots").alias("item_slots"))
    hits = of_docs.join(right, "h").withColumn("d", F.col("pos") - F.col("item_pos")).withColumn("same", F.col("item_slots").eqNullSafe(F.col("slots")))
    hits = hits.withColumn("pairs", F.arrays_zip(F.col("item_slots").alias("a"), F.col("slots").alias("b")))
    diagonals = hits.groupBy("doc", "item", "d").agg(F.collect_set("item_pos").alias("places"), F.collect_set(F.when(F.col("same"), F.col("item_pos"))).alias("same"), F.array_distinct(F.flatten(F.collect_set("pairs"))).alias("pairs"))
    found = diagonals.groupBy("doc", "item").agg(F.collect_list(F.struct("d", "places", "same", "pairs")).alias("diagonals")).join(reach, "item").select("doc", "item", "diagonals", "reach")
    out = T.StructType([T.StructField("doc", rows.schema["doc"].dataType), T.StructField("item", items.schema[item_id].dataType), T.StructField("coverage", T.DoubleType()), T.StructField("reparameterised", T.BooleanType())])
    return found.mapInArrow(_judge, out)


def drop_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_broadcast: int = 200_000, **more) -> DataFrame:
    """docs without those that contain an item; all columns stay.

    Up to max_broadcast ids, by a count, go to the executors; more are joined by a shuffle of docs.
    """
    bad = cut(_leaks(docs, items, id_col, text_col, **more).select(F.col("doc.id").alias("__bad"), F.col("doc.h").alias("__bad_text")).distinct())
    if bad.count() <= max_broadcast:
        bad = F.broadcast(bad)
    return docs.join(bad, docs[id_col].eqNullSafe(bad["__bad"]) & (F.xxhash64(docs[text_col]) == bad["__bad_text"]), "left_anti")
