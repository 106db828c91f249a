"""Language identification by hierarchical discrimination.

A text becomes the square roots of its byte-trigram counts, hashed into a fixed number of bins and scaled to
length one. Linear support vector machines first choose the language family, one machine for each pair of
families; then one machine for each pair of the family's languages chooses among them. Pairs vote; of equal
votes the larger sum of margins decides, then the alphabet.

The machines are fitted on the driver on a sample of `max_fit` labelled rows at most, spread evenly over the
languages and chosen by a hash of the id, of an id's clashing texts the one of the smallest hash; every row is predicted, from its
whole text.

A null text and one without a letter are `und` with score 0, as is every text where nothing could be learned.
A language of no known family is a family of its own. Repeated rows are predicted each.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ship, texts

#: Families of closely related languages.
FAMILIES = {
    "germanic": "af da de en fy is lb nb nl nn no sv yi",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "indic": "bn gu hi mr ne pa ur",
    "turkic": "az kk ky tr tt uz",
    "uralic": "et fi hu",
    "semitic": "am ar he mt",
    "sinitic": "yue zh",
    "austronesian": "id jv ms su tl",
}
FAMILY_OF = {lang: family for family, langs in FAMILIES.items() for lang in langs.split()}
BINS = 1 << 13
_STEP = 1 << 20
_CLEAN = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


def features(text: str) -> np.ndarray:
    """The text's unit vector; long texts are counted in steps."""
    raw = text.lower().encode("utf-8", "surrogatepass").translate(_CLEAN)
    counts = np.zeros(BINS, np.float64)
    for i in range(0, max(1, len(raw)), _STEP):
        a = np.frombuffer(raw[max(0, i - 2) : i + _STEP], np.uint8).astype(np.uint32)
        if len(a) < 3:
            continue
        code = ((a[:-2] << 16) | (a[1:-1] << 8) | a[2:]) * np.uint32(2654435761)
        counts += np.bincount(code >> np.uint32(32 - 13), minlength=BINS)
    x = np.sqrt(counts)
    return (x / (np.linalg.norm(x) or 1.0)).astype(np.float32)


def family_of(lang: str) -> str:
    return FAMILY_OF.get(lang.lower().split("-")[0].split("_")[0], f"family of {lang}")


def fit_pair(x: np.ndarray, y: np.ndarray, penalty: float = 1e-4, rounds: int = 150) -> np.ndarray:
    """Weights and bias of a linear machine with squared hinge loss, by accelerated gradient steps. y: -1 or 1."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    w = v = np.zeros(x.shape[1], np.float32)
    step = np.float32(1 / (2 * 2 + penalty))
    for k in range(rounds):
        slack = np.maximum(0, 1 - y * (x @ v))
        grad = -2 * (x.T @ (share * y * slack)) + penalty * v
        new = v - step * grad
        v = new + np.float32(k / (k + 3)) * (new - w)
        w = new
    return w


@dataclass
class Votes:
    """Pairwise machines over some classes."""

    classes: list[str]
    pairs: list[tuple[int, int]] = field(default_factory=list)
    weights: np.ndarray | None = None

    @staticmethod
    def fit(x: np.ndarray, labels: list[str]) -> Votes:
        classes = sorted(set(labels))
        pairs, rows, at = list(combinations(range(len(classes)), 2)), [], np.array([classes.index(c) for c in labels])
        for i, j in pairs:
            use = (at == i) | (at == j)
            rows.append(fit_pair(x[use], np.where(at[use] == i, 1, -1).astype(np.float32)))
        return Votes(classes, pairs, np.array(rows, np.float32).T if rows else None)

    def choose(self, x: np.ndarray) -> tuple[str, float]:
        """The winner and its smallest chance against another class."""
        if self.weights is None:
            return self.classes[0], 1.0
        margins = x @ self.weights[:-1] + self.weights[-1]
        votes, sums = np.zeros(len(self.classes)), np.zeros(len(self.classes))
        for (i, j), m in zip(self.pairs, margins):
            votes[i if m >= 0 else j] += 1
            sums[i] += m
            sums[j] -= m
        best = max(range(len(self.classes)), key=lambda k: (votes[k], sums[k], -k))
        low = min(m if i == best else -m for (i, j), m in zip(self.pairs, margins) if best in (i, j))
        return self.classes[best], float(1 / (1 + np.exp(-3 * np.clip(low, -20, 20))))


@dataclass
class Model:
    families: Votes | None
    within: dict[str, Votes]

    @staticmethod
    def fit(x: np.ndarray, langs: list[str]) -> Model:
        if not langs:
            return Model(None, {})
        of = [family_of(c) for c in langs]
        within = {}
        for f in set(of):
            use = [k for k, c in enumerate(of) if c == f]
            within[f] = Votes.fit(x[use], [langs[k] for k in use])
        return Model(Votes.fit(x, of), within)

    def predict(self, text: str | None) -> tuple[str, float]:
        if text is None or self.families is None or not any(map(str.isalpha, text)):
            return "und", 0.0
        x = features(text)
        family, p = self.families.choose(x)
        lang, q = self.within[family].choose(x)
        return lang, p * q


def sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, max_fit: int) -> DataFrame:
    """(text, lang) of max_fit rows at most: of each language the texts of the ids with the smallest hashes.

    Only ids and languages are ranked, without repeats; a language whose ids lie in one hash range is thinned by hash buckets
    first, each bucket ranked for itself, so that no task ranks a whole language. Of an id's clashing texts the one
    with the smallest hash stays.
    """
    labelled = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("body"), F.col(lang_col).alias("of")).withColumn("h", F.xxhash64("id"))
    distinct = labelled.select("of", "h").distinct()
    n = labelled.select("of").distinct().count()
    most = max(1, max_fit // max(1, n))
    # In two steps: the first `most` of each of 64 buckets of a language, then of those the first `most`.
    first = Window.partitionBy("of", "bucket").orderBy("h")
    few = distinct.withColumn("bucket", F.pmod(F.xxhash64("h"), F.lit(64))).withColumn("k", F.row_number().over(first)).where(F.col("k") <= most)
    ranked = few.withColumn("k", F.row_number().over(Window.partitionBy("of").orderBy("h"))).where(F.col("k") <= most).select(F.col("of").alias("name"), F.col("h").alias("low"))
    chosen = labelled.join(F.broadcast(ranked), (F.col("of") == F.col("name")) & (F.col("h") == F.col("low")))  # max_fit rows at most
    return chosen.groupBy("of", "h").agg(F.min(F.struct(F.xxhash64("body").alias("t"), "body")).alias("row")).select("row.body", "of")


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_fit: int = 3000) -> Model:
    """docs: the rows that may be learned from."""
    ship(docs.sparkSession)

    def vectors(batches):
        for b in batches:
            xs = [features(t) for t in texts(b, "body")]
            at = [np.flatnonzero(x) for x in xs]
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(at, pa.list_(pa.int64())), pa.array([x[i] for x, i in zip(xs, at)], pa.list_(pa.float32()))], ["of", "at", "x"])

    rows = sample(docs, id_col, text_col, lang_col, max_fit).mapInArrow(vectors, "of string, at array<long>, x array<float>").toArrow()
    x = np.zeros((rows.num_rows, BINS), np.float32)
    for k, (at, v) in enumerate(zip(rows.column("at"), rows.column("x"))):
        x[k, at.values.to_numpy()] = v.values.to_numpy()
    langs = rows.column("of").to_pylist()
    order = np.lexsort((x[:, :64].sum(axis=1), np.array(langs, str))) if langs else []
    return Model.fit(x[order] if langs else x, [langs[k] for k in order])


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) for each row of docs."""
    spark = docs.sparkSession
    ship(spark)
    known = spark.sparkContext.broadcast(model)

    def run(batches):
        m = known.value
        for b in batches:
            rows = [m.predict(t) for t in texts(b, text_col)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.float64())], [id_col, "lang_pred", "score"])

    out = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.select(id_col, text_col).mapInArrow(run, out)
