import random

from pyspark.sql import functions as F

from sedra.llm import language
from sedra.llm.common import crc32_mod

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, h int"
PARTS = {
    "en": "the and ing tion with that this which would", "de": "der und ung nicht schon eine über straße können", "fr": "le et tion avec être où garçon déjà nous",
    "es": "el y ción con está niño señor donde más", "xx": "kwaq zolu qarr wexo juqi zzap",
}


def corpus(n=600):
    rng, rows = random.Random(8), []
    for i in range(n):
        lang = rng.choice(list(PARTS))
        rows.append((i, " ".join(rng.choice(PARTS[lang].split()) for _ in range(rng.randint(5, 60))).capitalize(), lang, "s", 1, "x", 2))
    return rows


def test_held_out_accuracy(spark):
    rows = corpus()
    df = spark.createDataFrame(rows + [(9001, None, "en", None, None, None, None), (9002, "12 34 !?", "de", "s", 1, "x", 2), (9003, "", None, "s", 0, "x", 2), (None, "the and that this", None, None, 5, "x", 2)], SCHEMA)
    model = language.fit(df.where(crc32_mod("doc_id", 4) != 2), max_fit=200)
    assert sorted(model.within) == ["family of xx", "germanic", "romance"]
    got = {r.doc_id: r for r in language.predict(df, model).collect()}
    held = [r.doc_id for r in df.where(crc32_mod("doc_id", 4) == 2).select("doc_id").collect()]
    held = [i for i in held if i < 9000]
    assert sum(got[i].lang_pred == rows[i][2] for i in held) >= 0.97 * len(held) > 0
    assert all((got[i].lang_pred, got[i].score) == ("und", 0.0) for i in (9001, 9002, 9003))
    assert got[None].lang_pred == "en" and all(0 <= r.score <= 1 for r in got.values())
    again = language.fit(df.repartition(3).where(crc32_mod("doc_id", 4) != 2), max_fit=200)
    assert sorted(map(str, language.predict(df, again).select("doc_id", "lang_pred").collect())) == sorted(map(str, language.predict(df, model).select("doc_id", "lang_pred").collect()))


def test_sample_is_bounded_and_even(spark):
    df = spark.createDataFrame(corpus() * 3, SCHEMA)
    n = {r.of: r["count"] for r in language.sample(df, "doc_id", "text", "lang", 100).groupBy("of").count().collect()}
    assert n == dict.fromkeys(PARTS, 20)


def test_nothing_to_learn(spark):
    df = spark.createDataFrame([(1, "some text", None, "s", 1, "x", 2)], SCHEMA)
    assert [tuple(r) for r in language.predict(df, language.fit(df)).collect()] == [(1, "und", 0.0)]
    one = df.withColumn("lang", F.lit("en"))
    assert [r.lang_pred for r in language.predict(one, language.fit(one)).collect()] == ["en"]
    none = df.limit(0)
    assert language.predict(none, language.fit(none)).count() == 0


def test_rows_of_few_ids_are_learned_too(spark):
    rows = [(7, t, "de", "s", 1, "x", 2) for _, t, lang, *_ in corpus(600) if lang == "de"] * 5 + [r for r in corpus(600) if r[2] == "en"]
    df = spark.createDataFrame(rows, SCHEMA)
    n = {r.of: r["count"] for r in language.sample(df, "doc_id", "text", "lang", 100).groupBy("of").count().collect()}
    assert n == {"de": 1, "en": 50}
    a, b = (sorted(map(tuple, language.sample(d, "doc_id", "text", "lang", 100).collect())) for d in (df, df.repartition(5)))
    assert a == b


def test_votes_against_a_plain_machine():
    """The machines again, in plain Python: squared hinge loss by small gradient steps, votes, margins, the alphabet."""
    rng = random.Random(3)
    centres = {"a": (2, 0), "b": (-1, 2), "c": (-1, -2)}
    rows = [(lang, [x + rng.gauss(0, 0.4) for x in centres[lang]]) for lang in centres for _ in range(40)]
    x, labels = language.np.array([v for _, v in rows], language.np.float32), [lang for lang, _ in rows]
    votes = language.Votes.fit(x, labels)

    def plain(pos, neg):
        w = [0.0, 0.0, 0.0]
        for _ in range(4000):
            g = [1e-4 * v for v in w]
            for side, group in ((1, pos), (-1, neg)):
                for v in group:
                    slack = max(0.0, 1 - side * (w[0] * v[0] + w[1] * v[1] + w[2]))
                    for k, u in enumerate((*v, 1.0)):
                        g[k] -= 2 * 0.5 / len(group) * side * slack * u
            w = [a - 0.05 * b for a, b in zip(w, g)]
        return w

    of = {c: [v for lang, v in rows if lang == c] for c in "abc"}
    machines = {(i, j): plain(of[i], of[j]) for i, j in (("a", "b"), ("a", "c"), ("b", "c"))}
    for _ in range(200):
        v = [rng.uniform(-3, 3), rng.uniform(-3, 3)]
        won, margin = dict.fromkeys("abc", 0), dict.fromkeys("abc", 0.0)
        near = False
        for (i, j), w in machines.items():
            m = w[0] * v[0] + w[1] * v[1] + w[2]
            near |= abs(m) < 0.1
            won[i if m >= 0 else j] += 1
            margin[i], margin[j] = margin[i] + m, margin[j] - m
        best = min("abc", key=lambda c: (-won[c], -margin[c], c))
        assert near or votes.choose(language.np.array(v, language.np.float32))[0] == best
