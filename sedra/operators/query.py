"""Understanding of questions: formal terms, atomic intents, routing, history, answers' parts. All are columns."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import AFTER, BEFORE, squeezed, stripped
from ..plans import lexicon as L


def _map(table: Mapping[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])


def _any_of(phrases: Sequence[str]) -> str:
    return "|".join(re.escape(p).replace(r"\ ", " ") for p in phrases)


def replaced_once(text: Column, table: Mapping[str, str]) -> Column:
    """Every key, longest first, in one pass: what was put in is not looked at again."""
    keys = sorted(table, key=len, reverse=True)
    pattern = f"(?iu){BEFORE}(?:{_any_of(keys)}){AFTER}"
    known = _map({k.lower(): v for k, v in table.items()})
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    put = F.transform(found, lambda m: F.coalesce(F.try_element_at(known, F.lower(m)), m))
    return F.array_join(F.zip_with(F.split(text, pattern, -1), put, lambda gap, m: F.concat(gap, F.coalesce(m, F.lit("")))), "")


def rewrite(text: Column, synonyms: Mapping[str, str] | None = None) -> Column:
    """Colloquial phrases as formal terms; repeated phone phrases once; white space squeezed. Null gives an empty text."""
    text = F.coalesce(text, F.lit(""))
    text = stripped(F.regexp_replace(text, f"(?iu){BEFORE}k{AFTER}", "không"))
    text = replaced_once(text, synonyms or L.SYNONYMS)
    for phrase in ("sử dụng điện thoại di động", "điện thoại di động"):
        text = stripped(F.regexp_replace(text, rf"(?:{phrase}\s*)+", f"{phrase} "))
    return squeezed(text)


# What names a vehicle in a question.
MOTO = ["xe máy", "mô tô", "xe gắn máy", "mũ bảo hiểm", "nón bảo hiểm"]
MOTO_NAMES = ["xe máy", "mô tô", "xe gắn máy"]
AUTO = ["ô tô", "xe hơi", "xe tải", "xe khách", "xe buýt", "xe con", "xe ben", "xe bốn bánh", "xe 4 bánh"]
OTHERS = ["xe đạp điện", "xe đạp máy", "xe đạp", "đi bộ", "người đi bộ", "xe thô sơ", "xe lăn", "xe cứu thương", "xe cứu hỏa"]
MOTORWAY, A_CAR, A_MOTO = "cao tốc", "xe ô tô", "xe mô tô"
MIN_CHARS = 15


def deconstruct(text: Column, connectors: Sequence[str] | None = None) -> Column:
    """The atomic questions in a compound one, as an array; a blank text gives none.

    The text is cut at connectors, at stops that are not between digits, and before words that open a new
    intent. Parts with such a word, or of 15 characters, stay. A part that names no vehicle gets the
    question's; where the question is about cars and motorcycles, it is asked for both. Other vehicles
    (bicycles, walkers, ambulances) are only passed on.
    """
    words = lambda ps: f"(?iu){BEFORE}(?:{_any_of(ps)}){AFTER}"
    opens = "|".join(L.VIOLATION_KEYWORDS)
    links = "|".join(f"{BEFORE}{re.escape(c)}{AFTER}".replace(r"\ ", " ") for c in connectors or L.CONNECTORS)
    cut = rf"(?iu)(?={BEFORE}(?:{opens}){AFTER})|(?<!\d)[.;](?!\d)|{links}"
    whole = stripped(F.coalesce(text, F.lit("")))
    car, names = words(["ô tô"]), "|".join(MOTO_NAMES)

    def about(asked: Column) -> Column:
        """What the whole question names, computed once."""
        first = None
        for v in OTHERS:
            test = F.contains(asked, F.lit(v))
            first = F.when(test, v) if first is None else first.when(test, v)
        moto = asked.rlike(words(MOTO))
        auto = asked.rlike(words(AUTO)) | (F.contains(asked, F.lit(MOTORWAY)) & ~moto)
        return F.struct(moto.alias("moto"), auto.alias("auto"), asked.rlike(words(OTHERS)).alias("other"), first.alias("passed_on"))

    def formal(part: Column) -> Column:
        low = F.lower(part)
        part = F.when(low.rlike(car) & ~F.contains(low, F.lit(A_CAR)), F.regexp_replace(part, car, A_CAR)).otherwise(part)
        return F.when(low.rlike(names) & ~F.contains(F.lower(part), F.lit(A_MOTO)), F.regexp_replace(part, words(MOTO_NAMES), A_MOTO)).otherwise(part)

    def named(part: Column, main: Column) -> Column:
        low = F.lower(part)
        moto = low.rlike(words(MOTO)) | (low.rlike(names) & ~F.contains(low, F.lit(A_MOTO)))
        auto = low.rlike(words(AUTO)) | (F.contains(low, F.lit(MOTORWAY)) & ~main["moto"])
        return F.struct(formal(part).alias("text"), moto.alias("moto"), auto.alias("auto"), low.rlike(words(OTHERS)).alias("other"))

    def questions(here: Column, main: Column) -> Column:
        led = lambda v: F.concat(F.lit(v + " "), here["text"])
        none = ~here["moto"] & ~here["auto"]
        passed = F.when(none & ~here["other"] & main["passed_on"].isNotNull(), F.concat(main["passed_on"], F.lit(" "), here["text"])).otherwise(here["text"])
        both = (here["moto"] & here["auto"]) | (none & main["moto"] & main["auto"])
        return (
            F.when(main["other"], F.array(passed))
            .when(both, F.array(led(A_CAR), led(A_MOTO)))
            .when(none & main["moto"], F.array(led(A_MOTO)))
            .when(none & main["auto"], F.array(led(A_CAR)))
            .otherwise(F.array(here["text"]))
        )

    parts = F.transform(F.split(whole, cut, -1), lambda p: stripped(p))
    kept = F.filter(parts, lambda p: (p != "") & (p.rlike(f"(?iu){opens}") | (F.length(p) >= MIN_CHARS)))
    split = F.transform(F.array(about(F.lower(whole))), lambda main: F.flatten(F.transform(F.transform(kept, lambda p: named(p, main)), lambda h: questions(h, main))))[0]
    return F.when(whole == "", F.array().cast("array<string>")).otherwise(F.transform(F.array(split), lambda out: F.when(F.size(out) == 0, F.array(whole)).otherwise(out))[0])


def route(text: Column, intents: Column | None = None, max_words: int = 30) -> Column:
    """cloud for long, compound (3 intents) or grave questions, else local."""
    clean = stripped(F.coalesce(text, F.lit("")))
    low = F.lower(clean)
    n_words = F.when(clean == "", 0).otherwise(F.size(F.split(clean, r"(?U)\s+")))
    some = lambda ps: low.rlike(_any_of(ps))
    far = (n_words > max_words) | (F.size(intents if intents is not None else deconstruct(text)) >= 3) | some(L.ROUTE_ALWAYS) | some(L.ROUTE_COMPLEX)
    return F.when((clean != "") & far, "cloud").otherwise("local")


def last(array: Column, n: int) -> Column:
    """The last n entries, all where there are fewer."""
    return F.slice(array, F.greatest(F.lit(1), F.size(array) - (n - 1)), F.lit(n))


THOUGHT = r"(?isu)<thought>(.*?)</thought>"


def history(messages: Column, n: int = 5, length: int = 200) -> Column:
    """The last messages (role, content) as lines, without thoughts, long ones cut short."""

    def line(m):
        text = stripped(F.regexp_replace(F.coalesce(m["content"], F.lit("")), THOUGHT, ""))
        text = F.when(F.length(text) > length, F.concat(F.substring(text, 1, length), F.lit("..."))).otherwise(text)
        return F.concat(F.lit("- "), F.when(m["role"] == "user", "Người dùng").otherwise("Trợ lý"), F.lit(": "), text)

    return F.array_join(F.transform(last(messages, n), line), "\n")


def split_answer(text: Column) -> Column:
    """(thought, answer): the first thought's body, and what follows the last one, without the prefix `Trả lời:`."""
    text = F.coalesce(text, F.lit(""))
    thought = F.when(text.rlike(THOUGHT), stripped(F.regexp_extract(text, THOUGHT, 1)))
    rest = F.when(text.rlike(THOUGHT), stripped(F.element_at(F.split(text, "(?iu)</thought>", -1), -1))).otherwise(text)
    return F.struct(thought.alias("thought"), F.when(rest.startswith("Trả lời:"), stripped(F.substring(rest, F.lit(9), F.length(rest)))).otherwise(rest).alias("answer"))


# Prefixes that a rewriting model puts before its question.
PREFIXES = ["Câu hỏi viết lại:", "Viết lại:", "Câu hỏi độc lập:", "Câu hỏi độc lập viết lại:", "Viết lại câu hỏi:"]


def reformulated(original: Column, reply: Column, has_history: Column) -> Column:
    """A model's stand-alone question without quotes and prefixes; the original without history or without a reply."""
    text = stripped(F.coalesce(reply, F.lit("")))
    text = stripped(F.regexp_replace(text, "^(?:\"(.*)\"|'(.*)')$", "$1$2"))
    for p in PREFIXES:
        text = stripped(F.regexp_replace(text, f"^(?iu){re.escape(p)}".replace(r"\ ", " "), ""))
    return F.when(has_history & (text != ""), text).otherwise(original)
