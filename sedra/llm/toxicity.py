"""Toxicity by a weighted finite-state pattern grammar.

Words become symbols: insult (with a weight), target, negation, reported speech, agent, modal, violence, end
of clause. Small transducers read a clause's symbols side by side, as one composed machine: one each for
insults, negation, reported speech, targets and threats. An insult counts in full where its clause aims it at a target, before or after it,
or heaps it on another insult; mentioned by itself it counts for a small share. Negation and reported speech take away from both. A threat
(agent, modal, violence, target, in this order) counts by itself. Clauses are scored whole, and
a document's score is a logistic function of its clauses' sums, so isolated words count for less than
matched clauses, and a stem that others use now and then for less than one used all the time.

The insult lexicon (words and word stems) and the logistic weights are learned on a sample of `max_fit`
labelled rows at most, chosen by a hash of the id; every row is scored, over its whole text.

Null and blank texts match nothing and get the score of a text without a match. Repeated rows are scored
each; of an id's clashing texts the one with the smallest hash is learned from. Rows without a label, and ids with contradicting
labels (the larger wins), do no harm. Where nothing
can be learned (no labels, or all alike) the score is the share of toxic labels, 0 without labels.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, ship, texts

OTHER, INSULT, TARGET, NEGATION, REPORT, AGENT, MODAL, VIOLENCE = range(8)
N_SYMBOLS = 8
#: Factors of an insult that stands by itself, and of one that is aimed or heaped.
ALONE, AIMED = 0.3, 1.5
_END = 16

#: Closed classes of the grammar, in the languages of the corpus.
WORDS = {
    TARGET: "you your yours yourself u ya him his her hers them their they he she du dich dir ihr euch sie ihn tu te toi vous ton ta tes ti usted vosotros",
    NEGATION: "not no never isn't aren't wasn't don't doesn't didn't won't can't without nicht kein keine keinen nie pas jamais ni nunca jamás sin",
    REPORT: "said says say called calls call claimed claims wrote writes quoted reported alleged accused sagte nannte schrieb dit appelé écrit dijo llamó escribió",
    AGENT: "i we i'll we'll ich wir je nous yo nosotros someone somebody",
    MODAL: "will shall gonna going should must would werde werden vais allons voy vamos",
    VIOLENCE: "kill hurt beat destroy shoot stab burn punch hang strangle murder töten schlagen umbringen tuer frapper matar golpear",
}
CLOSED = {w: k for k, ws in WORDS.items() for w in ws.split()}
EDGES = ".,;:!?\"'()[]{}*#$%&|<>-–—…“”‘’«»¿¡/\\+=~^`@_"
STOPS = ".,;:!?…|"


class Negation:
    """State: how many more words a negation reaches. Its output factor falls on insults."""

    states = range(4)

    @staticmethod
    def step(state: int, symbol: int) -> tuple[int, float]:
        if symbol == NEGATION:
            return 3, 1.0
        return max(0, state - 1), 0.4 if state and symbol == INSULT else 1.0


class Reported:
    """State: whether the clause has spoken of speech before."""

    states = range(2)

    @staticmethod
    def step(state: int, symbol: int) -> tuple[int, float]:
        if symbol == REPORT:
            return 1, 1.0
        return state, 0.6 if state and symbol == INSULT else 1.0


class Insulting:
    """State: how many more words an insult reaches back over to the next one. Heaped insults are matched."""

    states = range(3)

    @staticmethod
    def step(state: int, symbol: int) -> tuple[int, float]:
        if symbol == INSULT:
            return 2, AIMED / ALONE if state else 1.0
        return max(0, state - 1), 1.0


class Targeted:
    """State: how many more words a target reaches forward, and an insult that waits for a target reaches back to it."""

    states = tuple(product(range(5), range(4)))

    @staticmethod
    def step(state: tuple[int, int], symbol: int) -> tuple[tuple[int, int], float]:
        ahead, waiting = state
        if symbol == TARGET:
            return (4, 0), AIMED / ALONE if waiting else 1.0  # the factor of the insult that waited
        if symbol == INSULT:
            return (max(0, ahead - 1), 0 if ahead else 3), AIMED / ALONE if ahead else 1.0
        return (max(0, ahead - 1), max(0, waiting - 1)), 1.0


class Threat:
    """State: how much of agent, modal, violence the clause has had. A target after all three completes it."""

    states = range(4)

    @staticmethod
    def step(state: int, symbol: int) -> tuple[int, float]:
        want = (AGENT, MODAL, VIOLENCE, TARGET)[state]
        if symbol == want:
            return (0, 2.0) if state == 3 else (state + 1, 1.0)
        return (1, 1.0) if symbol == AGENT else (state, 1.0)


def compose(*machines) -> dict:
    """The product machine: (states, symbol) to (states, factor of an insult, whether it is matched, completed threats, factor of an insult before)."""
    table = {}
    for states in product(*(m.states for m in machines)):
        for symbol in range(N_SYMBOLS):
            moves = [(m, *m.step(s, symbol)) for m, s in zip(machines, states)]
            matched = max([f for m, _, f in moves if m in (Insulting, Targeted)], default=1.0)
            other = float(np.prod([f for m, _, f in moves if m not in (Insulting, Targeted, Threat)]))
            threats = sum(f > 1 for m, _, f in moves if m is Threat)
            here = matched * other if symbol == INSULT else 1.0
            table[states, symbol] = tuple(s for _, s, _ in moves), here, matched > 1, threats, matched if symbol == TARGET else 1.0
    return table


GRAMMAR = compose(Insulting, Negation, Reported, Targeted, Threat)
START = (0, 0, 0, (0, 0), 0)


def score_clause(symbols: list[int], weights: list[float]) -> tuple[float, int]:
    """(weight of the insults matched, threats) of a clause."""
    state, total, threats, waiting = START, 0.0, 0, 0.0
    for s, w in zip(symbols, weights):
        state, factor, matched, t, before = GRAMMAR[state, s]
        threats += t
        if s == INSULT:
            value = w * ALONE * factor
            total, waiting = total + value, 0.0 if matched else value
        elif before > 1:
            total, waiting = total + waiting * (before - 1), 0.0
    return total, threats


@dataclass
class Lexicon:
    """Weights of insults: whole words, and stems that begin a longer word."""

    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)

    def weight(self, word: str) -> float:
        best = self.words.get(word, 0.0)
        for n in range(4, min(len(word), 8)):
            best = max(best, self.stems.get(word[:n], 0.0))
        return best


class Symbols(dict):
    """Raw word to its symbol, plus _END where it ends a clause, as an int."""

    def __init__(self, lexicon: Lexicon, most: int = 300_000):
        super().__init__()
        self.lexicon, self.most = lexicon, most

    def __missing__(self, raw: str) -> int:
        if len(self) >= self.most:
            self.clear()
        word = raw.strip(EDGES).lower()
        k = CLOSED.get(word, OTHER)
        if self.lexicon.weight(word) > 0:
            k = INSULT
        if raw[-1] in STOPS:
            k |= _END
        if len(raw) <= 40:
            self[raw] = k
        return k


N_FEATURES = 7


def match(text: str | None, symbols: Symbols) -> list[float]:
    """The features of a text: from the sums of its clauses."""
    words = text.split() if text else []
    if not words:
        return [0.0] * N_FEATURES
    codes = np.fromiter(map(symbols.__getitem__, words), np.uint8, len(words))
    kinds = codes & (_END - 1)
    triggers = np.flatnonzero((kinds == INSULT) | (kinds == VIOLENCE))
    if not len(triggers):
        return [0.0] * N_FEATURES
    ends = np.flatnonzero(codes & _END)
    clause = np.unique(np.searchsorted(ends, triggers))
    total, most, hit, threats, named = 0.0, 0.0, 0, 0, 0.0
    for c in clause.tolist():
        a, b = (int(ends[c - 1]) + 1 if c else 0), (int(ends[c]) + 1 if c < len(ends) else len(words))
        ks = kinds[a:b].tolist()
        weights = [symbols.lexicon.weight(words[a + i].strip(EDGES).lower()) if k == INSULT else 0.0 for i, k in enumerate(ks)]
        s, t = score_clause(ks, weights)
        total, most, hit, threats, named = total + s, max(most, s), hit + (s > 0), threats + t, named + max(weights, default=0.0)
    rate = 100.0 * total / (len(words) + 20)
    # The last one: what the clauses name, matched or not.
    return [float(np.log1p(total)), float(np.log1p(rate)), most, float(np.log1p(hit)), float(np.log1p(100.0 * hit / (len(words) + 20))), float(threats > 0), float(np.log1p(named))]


def grams(text: str) -> set[str]:
    """Words, and stems marked by a star, of a text."""
    out = set()
    for raw in set(text.split()):
        word = raw.strip(EDGES).lower()
        if len(word) >= 3 and not any(map(str.isdigit, word)):
            out.add(word)
            out.update(word[:n] + "*" for n in range(4, min(len(word), 8)))
    return out


@dataclass
class Model:
    lexicon: Lexicon
    weights: np.ndarray | None
    mean: np.ndarray | None
    scale: np.ndarray | None
    base: float

    def score(self, x) -> float:
        if self.weights is None:
            return self.base
        z = float(((np.asarray(x) - self.mean) / self.scale) @ self.weights[:-1] + self.weights[-1])
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def fit_logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1e-3, rounds: int = 60) -> np.ndarray:
    """Newton's method."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], penalty * len(x) / 100)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + ridge * w
        h = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(ridge)
        move = np.linalg.solve(h, g)
        w -= move
        if np.abs(move).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_fit: int = 8000, max_lexicon: int = 600) -> Model:
    """labels: the rows that may be learned from."""
    spark = docs.sparkSession
    ship(spark)
    of = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg((F.max(label_col) > 0).cast("int").alias("y"))
    of = of.orderBy(F.xxhash64("id"), "id").limit(max_fit)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("body")).where(F.col("body").isNotNull())
    one = rows.join(F.broadcast(of), "id").groupBy("id").agg(F.min(F.struct(F.xxhash64("body").alias("h"), "body", "y")).alias("row"))
    chosen = cut(one.select("row.body", "row.y"))
    n = {r.y: r["count"] for r in chosen.groupBy("y").count().collect()}
    toxic, clean = n.get(1, 0), n.get(0, 0)
    if not toxic or not clean:
        return Model(Lexicon(), None, None, None, 1.0 if toxic else 0.0)

    def count(batches):
        for b in batches:
            found: dict[int, Counter] = {0: Counter(), 1: Counter()}
            for t, y in zip(texts(b, "body"), texts(b, "y")):
                found[y].update(grams(t))
            keys = list(found[0].keys() | found[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *(pa.array([found[y][k] for k in keys], pa.int64()) for y in (1, 0))], ["gram", "pos", "neg"])

    counted = chosen.mapInArrow(count, "gram string, pos long, neg long").groupBy("gram").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    lift = (F.col("pos") + 0.1) / F.lit(float(toxic)) / ((F.col("neg") + 0.5) / F.lit(float(clean)))
    best = counted.where(F.col("pos") >= max(3, toxic // 200)).withColumn("weight", F.log(lift)).where("weight > 1.6")
    lexicon = Lexicon()
    for r in best.orderBy(F.desc(F.col("weight") * F.col("pos")), "gram").limit(max_lexicon).collect():
        (lexicon.stems if r.gram.endswith("*") else lexicon.words)[r.gram.rstrip("*")] = round(r.weight, 4)

    def describe(batches):
        symbols = Symbols(lexicon)
        for b in batches:
            xs = [match(t, symbols) for t in texts(b, "body")]
            yield pa.RecordBatch.from_arrays([pa.array(xs, pa.list_(pa.float64())), b.column(1)], ["x", "y"])

    got = chosen.mapInArrow(describe, "x array<double>, y int").collect()
    got.sort(key=lambda r: (r.y, r.x))
    x, y = np.array([r.x for r in got]), np.array([r.y for r in got], float)
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale < 1e-9] = 1.0
    return Model(lexicon, fit_logistic((x - mean) / scale, y), mean, scale, toxic / (toxic + clean))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, clause_weight, n_clauses, threat) for each row of docs."""
    spark = docs.sparkSession
    ship(spark)
    known = spark.sparkContext.broadcast(model)

    def run(batches):
        m = known.value
        symbols = Symbols(m.lexicon)
        for b in batches:
            xs = [match(t, symbols) for t in texts(b, text_col)]
            cols = [pa.array([m.score(x) for x in xs], pa.float64()), pa.array([float(np.expm1(x[0])) for x in xs], pa.float64()), pa.array([round(float(np.expm1(x[3]))) for x in xs], pa.int64()), pa.array([x[5] > 0 for x in xs], pa.bool_())]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], [id_col, "score", "clause_weight", "n_clauses", "threat"])

    out = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("score", T.DoubleType()), T.StructField("clause_weight", T.DoubleType()), T.StructField("n_clauses", T.LongType()), T.StructField("threat", T.BooleanType())])
    return docs.select(id_col, text_col).mapInArrow(run, out)
