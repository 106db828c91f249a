import random

from sedra.llm import toxicity as t
from sedra.llm.common import crc32_mod

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, y int"
LEX = t.Lexicon({"blorg": 3.0}, {"snarf": 2.0})


def parts(text):
    return t.match(text, t.Symbols(LEX))


def weight(text):
    return round(float(t.np.expm1(parts(text)[0])), 6)


def test_grammar_on_clauses():
    assert weight("the blorg sat") == round(3.0 * t.ALONE, 6)
    assert weight("you are a blorg") == 4.5 == weight("what a blorg are you")
    assert weight("he is not a blorg") == round(3.0 * 1.5 * 0.4, 6)
    assert weight("never, blorg") == round(3.0 * t.ALONE, 6)  # the negation ends with its clause
    assert weight("Smith said blorg things") == round(3.0 * t.ALONE * 0.6, 6)
    assert weight("Smith said. Blorg!") == round(3.0 * t.ALONE, 6)
    assert weight("a blorg blorg") == round(3.0 * t.ALONE + 4.5, 6)  # heaped
    assert weight("a blorg blorg, you") == weight("a blorg blorg")
    assert weight("a snarfeling and a snarf") == round(2.0 * t.ALONE, 6)  # a stem begins a longer word
    assert parts("I will surely kill you")[5] == 1.0 and parts("I will kill time")[5] == 0.0 and parts("you kill, I will")[5] == 0.0
    assert parts(None) == parts("") == parts("quite harmless words") == [0.0] * t.N_FEATURES


def test_a_mention_weighs_far_less_than_an_aimed_insult():
    mention, aimed = weight("The word blorg is an old noun"), weight("You are an old blorg")
    assert 0 < mention <= 0.25 * aimed


def test_composed_machine_equals_its_parts():
    rng = random.Random(9)
    machines = (t.Insulting, t.Negation, t.Reported, t.Targeted, t.Threat)
    for _ in range(300):
        symbols = [rng.randrange(t.N_SYMBOLS) for _ in range(rng.randint(1, 12))]
        states, total, threats, waiting = list(t.START), 0.0, 0, None
        for s in symbols:
            factor, matched, had = 1.0, 1.0, states[3][1]
            for i, m in enumerate(machines):
                states[i], f = m.step(states[i], s)
                threats += m is t.Threat and f > 1
                factor *= f if m in (t.Negation, t.Reported) else 1.0
                matched = max(matched, f if m in (t.Insulting, t.Targeted) else 1.0)
            if s == t.INSULT:
                value = t.ALONE * factor * matched
                total, waiting = total + value, 0.0 if matched > 1 else value
            elif s == t.TARGET and had:
                total += waiting * (t.AIMED / t.ALONE - 1)
        got = t.score_clause(symbols, [1.0] * len(symbols))
        assert abs(got[0] - total) < 1e-9 and got[1] == threats


def test_repeated_ids_with_clashing_texts_and_very_long_texts(spark):
    rows, labels = corpus(300)
    rows += [(3, "another text dolt dolt %d" % k, "en", "s", 1, "x", 2) for k in range(5)] + [(4, "word " * 200_000 + "you dolt", "en", "s", 1, "x", 2)]
    docs, marks = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, toxic int")
    first, again = ({(r.doc_id, r.score) for r in t.score(d, t.fit(d, marks)).collect()} for d in (docs, docs.repartition(7)))
    assert first == again


def corpus(n=1200):
    rng, rows, labels = random.Random(10), [], []
    words = ["w%s" % "abcdefghij"[i % 10] * (1 + i // 10) for i in range(60)]
    for i in range(n):
        ws = [rng.choice(words) for _ in range(rng.randint(20, 120))]
        toxic = rng.random() < 0.15
        if toxic:
            for _ in range(2):
                ws.insert(rng.randrange(len(ws)), rng.choice(["dolt", "Churl!", "gnarfix", "gnarfone"]))
        rows.append((i, " ".join(ws), "en", "s", 1, "x", 2))
        labels.append((i, int(toxic)))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows + [(5001, None, None, None, None, None, None), (5002, "", "en", "s", 0, "x", 2), (None, "you dolt", "en", "s", 1, "x", 2)], SCHEMA)
    marks = spark.createDataFrame([(i, 1, y) for i, y in labels] + [(7, 1, None), (9999, 0, 1), (None, 0, 1)], "doc_id long, quality int, toxic int")
    model = t.fit(docs, marks.where(crc32_mod("doc_id", 5) != 0), max_fit=600)
    got = {r.doc_id: r.score for r in t.score(docs, model).collect()}
    held = {r.doc_id for r in marks.where(crc32_mod("doc_id", 5) == 0).select("doc_id").collect()}
    pairs = [(got[i] >= 0.5, y == 1) for i, y in labels if i in held]
    assert len(pairs) > 100 and sum(a == b for a, b in pairs) >= 0.97 * len(pairs)
    assert got[5001] == got[5002] < 0.2 and got[None] > 0.5 and all(0 <= s <= 1 for s in got.values())


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "some text", "en", "s", 1, "x", 2)], SCHEMA)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.score for r in t.score(docs, t.fit(docs, none)).collect()] == [0.0]
    assert t.score(docs.limit(0), t.fit(docs.limit(0), none)).count() == 0
