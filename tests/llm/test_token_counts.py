import random
import tracemalloc

from tokenizers import Regex, Tokenizer, models, normalizers, pre_tokenizers

from sedra.llm import token_counts as tc

SCHEMA = "doc_id long, text string, lang string, n_tokens string"


def library(vocabulary):
    t = Tokenizer(models.Unigram(list(vocabulary.pieces), unk_id=0, byte_fallback=vocabulary.byte_fallback))
    t.normalizer = normalizers.Sequence([normalizers.Replace(Regex("[\\x20\\x09-\\x0D]+"), " "), normalizers.Replace(Regex("^ | $"), "")])
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement=tc.MARK, prepend_scheme="always", split=True)
    return lambda text: len(t.encode(text, add_special_tokens=False).ids)


def samples():
    rng = random.Random(6)
    out = ["", "a", "Hello world", " lead and trail \n", "naïve café ☃☃ 漢字かな \U0001f600x", "the " * 50, "<unk> x<unk>☃ <0x41>", "ababab aab bba", "x" * 3000]
    out += ["".join(rng.choice("ab cdé\n☃t") for _ in range(rng.randint(1, 80))) for _ in range(300)]
    return out


def test_counts_equal_the_library_on_a_public_vocabulary():
    v = tc.load_vocabulary()
    count, want = tc.Counter(v), library(v)
    for text in samples():
        assert count.text(text)[0] == want(text), text


def test_ties_and_unknowns_equal_the_library():
    pieces = (("<unk>", 0.0), (tc.MARK, -1.0), ("a", -2.0), ("b", -1.0), ("ab", -3.0), ("ba", -3.0), ("aba", -5.0), ("bab", -4.0), (tc.MARK + "a", -3.0), ("c", -2.5), ("cd", -1.0))
    for fallback in (False, True):
        v = tc.Vocabulary(pieces, fallback)
        count, want = tc.Counter(v), library(v)
        for text in samples():
            assert count.text(text)[0] == want(text), (fallback, text)


def test_rows(spark):
    rows = [(1, "Hello world", "en", "x"), (1, "Hello world", "en", "x"), (2, None, None, None), (3, " \n", "", ""), (None, "a", None, None)]
    got = tc.count_tokens(spark.createDataFrame(rows, SCHEMA)).collect()
    hello = library(tc.load_vocabulary())("Hello world")
    assert sorted((str(r.doc_id), r.n_tokens, r.n_words) for r in got) == [("1", hello, 2), ("1", hello, 2), ("2", 0, 0), ("3", 0, 0), ("None", 1, 1)]
    assert tc.count_tokens(spark.createDataFrame([], SCHEMA)).count() == 0


def test_memory_does_not_grow_with_the_word():
    counter = tc.Counter(tc.load_vocabulary())
    word = tc.MARK + "".join(chr(0x4E00 + (i * i) % 2000) for i in range(100_000))
    counter.word(word[:100])
    tracemalloc.start()
    n = counter.word(word)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1_000_000 and n >= 100_000
    assert n == library(tc.load_vocabulary())(word[1:])
