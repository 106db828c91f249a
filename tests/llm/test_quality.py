import re
from collections import Counter

from sedra.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
GOOD = "\n".join(f"The a{i} met b{i} and c{i} agreed d{i} to publish e{i} what f{i} had found." for i in range(8))


def brute(text):
    w = WORD.findall(text or "")
    windows = Counter(zip(w, w[1:], w[2:]))
    hit = set()
    for i, t in enumerate(zip(w, w[1:], w[2:])):
        if windows[t] > 1:
            hit |= {i, i + 1, i + 2}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    base = len(w) < 50 or 100 * len(hit) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(hit), base


def test_base_counts_equal_brute_force(spark):
    texts = [None, "", " \t\n\x0b", GOOD, GOOD + "\n" + GOOD, "a b c a b c a b c d\n\na b c\n", "é ß | x # y\r\nz " * 40, "a a a", "a a a a", "one two"]
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], SCHEMA)
    got = {r.doc_id: r for r in quality.quality_verdicts(df).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(t), t
        assert not (r.base_failed and r.kept)


def test_line_rules_and_loss():
    rules = quality.LineRules()
    fails = lambda s: quality.line_fails(s, len(s.split()), rules)
    assert fails("Home | About | Contact | More") == "symbols"
    assert fails("WINNER!! CLICK!! NOW!! AND!! HERE!!") == "capitals"
    assert fails("About us") == "navigation"
    assert fails("This work is licensed under the Creative Commons License.") == "boilerplate"
    assert fails("The committee met and agreed.") == ""
    assert fails("NASA met.") == ""
    assert fails("ÉTÉ ÀÇÔÛ ÄÖÜÑ ÉÈÊË et.") == "capitals" and fails("été àçôû äöüñ éèêë Et.") == "" and fails("normal words first, " * 6 + "THEN ALL OF IT IN LARGE LETTERS " * 9 + ".") == "capitals"
    assert quality.judge(GOOD)[6]
    assert quality.judge(GOOD + "\nAll rights reserved.\nHome")[6:8] == (True, GOOD)
    junk = "\n".join(f"Buy*** this%%% now&&& number{i}$$$ and### more!!!" for i in range(30))
    assert not quality.judge(junk)[6]
    assert not quality.judge(GOOD + "\n" + junk)[6]


def test_clean_documents(spark):
    rows = [(1, GOOD + "\nHome", "en", "s", 9, "x"), (1, GOOD + "\nHome", "en", "s", 9, "x"), (2, "short", "en", "s", 5, "y"), (3, None, "en", "s", 0, "z"), (None, GOOD, None, None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA + ", kept string")
    got = quality.clean_documents(df).collect()
    assert sorted((str(r.doc_id), r.text, r.n_chars, r.kept) for r in got) == sorted([("1", GOOD, len(GOOD), "x")] * 2 + [("None", GOOD, len(GOOD), None)], key=str)
    empty = spark.createDataFrame([], SCHEMA)
    assert quality.clean_documents(empty).count() == 0 and quality.quality_verdicts(empty).count() == 0
