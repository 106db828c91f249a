"""Quality rules: line-first cleaning.

Every line is judged on its own by punctuation, navigation and boilerplate rules. Lines that fail are
removed; a document goes if too much of its text was in such lines, or if it fails the base rules (too
few words, too much repetition).

Null text counts as no text; an empty or blank text has no words and fails the base rules. Repeated rows
are judged alike, each on its own. Whole texts are read; nothing is shuffled.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import ship, texts

SYMBOLS = "#*$%&|<>"
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
TERMINAL = ('.', '!', '?', '"', "'", "…", "”", "’", "»", ")", "]", ":", ";", "。", "！", "？", "।", "؟")

BOILERPLATE = re.compile(
    r"\b(?:cookies?|javascript|terms of (?:use|service)|privacy policy|all rights reserved|copyright|lorem ipsum"
    r"|sign (?:in|up)|log ?in|subscribe|newsletter|click here|read more|share (?:this|on)|follow us|powered by"
    r"|licensed under|released under|this work is licensed)\b|©",
    re.IGNORECASE,
)
CAPITALS, SMALL, NON_ASCII = bytes(range(65, 91)), bytes(range(97, 123)), bytes(range(128, 256))


@dataclass(frozen=True)
class LineRules:
    min_words: int = 50
    max_repeated: float = 0.5
    #: Symbols for each word of a line.
    max_symbols: float = 0.3
    #: Share of capitals among the letters of a line with this many letters at least.
    max_capitals: float = 0.6
    capitals_from: int = 12
    #: A line without end punctuation and of no more words than this is navigation.
    nav_words: int = 4
    #: A boilerplate phrase condemns a line of no more words than this.
    boilerplate_words: int = 40
    #: A document is rejected if the lines removed held more than this share of its words.
    max_lost: float = 0.4


def shouts(line: str, rules: LineRules) -> bool:
    """Whether capitals are too large a share of the line's letters.

    First a bound that counts ASCII letters at the speed of bytes and takes all other characters for capitals;
    only lines that it can't clear are read letter by letter.
    """
    raw = line.encode("utf-8", "surrogatepass")
    up, low = (len(raw) - len(raw.translate(None, x)) for x in (CAPITALS, SMALL))
    other = len(line) - len(raw.translate(None, NON_ASCII))
    if up + other <= rules.max_capitals * (up + low + other):
        return False
    letters = list(filter(str.isalpha, line))
    return len(letters) >= rules.capitals_from and sum(map(str.isupper, letters)) > rules.max_capitals * len(letters)


def line_fails(line: str, n_words: int, rules: LineRules) -> str:
    """The rule that the line fails, or an empty string. n_words: the line's words, one at least."""
    if sum(map(line.count, SYMBOLS)) > rules.max_symbols * n_words:
        return "symbols"
    if shouts(line, rules):
        return "capitals"
    if n_words <= rules.nav_words and not line.rstrip(SPACES).endswith(TERMINAL):
        return "navigation"
    if n_words <= rules.boilerplate_words and BOILERPLATE.search(line):
        return "boilerplate"
    return ""


def repeated_words(words: list) -> int:
    """Words that lie in a 3-word window found twice or more."""
    n = len(words)
    if n < 4:
        return 0
    seen: dict = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    k = len(seen)
    if k < 2_000_000:
        codes = (ids[:-2] * k + ids[1:-1]) * k + ids[2:]
    else:  # the codes would overflow: number the pairs first
        _, pairs = np.unique(ids[:-1] * k + ids[1:], return_inverse=True)
        codes = pairs[:-1] * k + ids[2:]
    order = np.sort(codes)
    double = order[1:][order[1:] == order[:-1]]
    if not len(double):
        return 0
    at = np.isin(codes, double)
    hit = np.zeros(n, bool)
    hit[:-2] |= at
    hit[1:-1] |= at
    hit[2:] |= at
    return int(hit.sum())


def judge(text: str | None, rules: LineRules = LineRules()) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, cleaned text, words lost)."""
    if text is None:
        return 0, 0, 0, 0, 0, True, False, "", 0
    words = text.encode("utf-8", "surrogatepass").split()  # bytes split at ASCII white space only
    n_words = len(words)
    word_chars = len(text) - sum(map(text.count, SPACES))
    n_symbols = sum(map(text.count, SYMBOLS))
    repeated = repeated_words(words)
    lines, counts, kept_lines, lost = text.split("\n"), set(), [], 0
    dup = 0
    for line in lines:
        n = len(line.encode("utf-8", "surrogatepass").split())
        if not n:
            kept_lines.append(line)
            continue
        if line in counts:
            dup += 1
        counts.add(line)
        if line_fails(line, n, rules):
            lost += n
        else:
            kept_lines.append(line)
    base_failed = n_words < rules.min_words or repeated > rules.max_repeated * n_words
    kept = not base_failed and lost <= rules.max_lost * n_words
    return n_words, word_chars, n_symbols, dup, repeated, base_failed, kept, "\n".join(kept_lines), lost


VERDICT = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    + [T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType()), T.StructField("n_lost_words", T.LongType())]
)


def quality_verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: LineRules = LineRules()) -> DataFrame:
    """One row for each row of docs: its id, the base counts, base_failed, kept, and the words in lines removed."""
    ship(docs.sparkSession)

    def run(batches):
        for b in batches:
            rows = [judge(t, rules) for t in texts(b, text_col)]
            cols = list(zip(*rows)) if rows else [()] * 9
            types = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(c, t) for c, t in zip([*cols[:7], cols[8]], types))], [id_col, *VERDICT.names]
            )

    out = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), *VERDICT.fields])
    return docs.select(id_col, text_col).mapInArrow(run, out)


def clean_documents(docs: DataFrame, text_col: str = "text", chars_col: str = "n_chars", rules: LineRules = LineRules()) -> DataFrame:
    """docs without the documents rejected, and without the failing lines of those kept; all columns stay.

    chars_col, where docs has it, becomes the length of the cleaned text.
    """
    ship(docs.sparkSession)
    names = docs.columns

    def run(batches):
        for b in batches:
            rows = [judge(t, rules) for t in texts(b, text_col)]
            i = b.schema.get_field_index(text_col)
            b = b.set_column(i, b.schema.field(i), pa.array([r[7] for r in rows], b.schema.field(i).type))
            if chars_col in names:
                i = b.schema.get_field_index(chars_col)
                b = b.set_column(i, b.schema.field(i), pa.array([len(r[7]) for r in rows], b.schema.field(i).type))
            yield b.filter(pa.array([r[6] for r in rows], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
