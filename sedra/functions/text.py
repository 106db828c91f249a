"""Text columns: cleaning and tokens."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as punctuation.
PUNCTUATION = string.punctuation + "“”‘’–—…«»"

#: What counts as white space in Unicode.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"

#: Boundaries of a word in any script; Java's and RE2's \b differ from each other outside ASCII.
BEFORE, AFTER = r"(?<![\p{L}\p{M}\p{N}_])", r"(?![\p{L}\p{M}\p{N}_])"


def stripped(text: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def cleaned(text: Column, lowercase: bool = True, remove_punctuation: bool = True) -> Column:
    """No-break spaces and white space squeezed, then lower case, then punctuation to spaces; all before segmentation."""
    out = squeezed(F.translate(text, " ", " "))
    if lowercase:
        out = F.lower(out)
    if remove_punctuation:
        out = squeezed(F.translate(out, PUNCTUATION, " " * len(PUNCTUATION)))
    return out


def tokens(text: Column, lowercase: bool = True, remove_punctuation: bool = True, segmenter=None) -> Column:
    """Array of tokens; null and blank texts give an empty one.

    segmenter: a function from the cleaned text column to one with multi-word terms joined by underscores,
    say a pandas UDF around a segmentation model. Without one no regular expression is needed: white space
    and punctuation become spaces, character by character, and the text is cut at single spaces.
    """
    text = F.coalesce(text, F.lit(""))
    if segmenter:
        parts = F.filter(F.split(segmenter(cleaned(text, lowercase, remove_punctuation)), r"(?U)\s+"), lambda t: t != "")
        return F.filter(parts, lambda t: ~t.rlike(r"^\p{Punct}+$")) if remove_punctuation else parts
    gone = SPACES + (PUNCTUATION if remove_punctuation else "")
    plain = F.translate(F.lower(text) if lowercase else text, gone, " " * len(gone))
    return F.array_remove(F.split(plain, " "), "")


def word(pattern: str) -> str:
    """pattern as a whole word or phrase, any case."""
    return f"(?iu){BEFORE}(?:{pattern}){AFTER}"


def has(text: Column, pattern: str) -> Column:
    return F.coalesce(text.rlike(pattern), F.lit(False))


def first_group(text: Column, pattern: str, group: int = 1) -> Column:
    """regexp_extract with null where nothing matches."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))
