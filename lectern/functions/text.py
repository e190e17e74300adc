"""Text cleaning and normalisation as Column expressions.

Everything runs inside the JVM except Unicode composition, which Spark lacks; that is an
Arrow function that sees only texts it may change.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python's str.split() and \s see it.
SPACES = "[\\s\\x0B\\x1c-\\x1f\\x85\\p{Z}]"
#: Fixed value: what normalisation replaces by a space.
OUTSIDE = "[^\\p{L}\\p{N}_\\s\\x0B\\x1c-\\x1f\\x85\\p{Z}'’À-ɏḀ-ỿ]"
#: Filler tags left out of annotations, and the tag of a whole label to skip.
FILLERS = ("<uu>", "<unk>", "<um>", "<noise>", "<mm>", "<eh>", "<ee>", "<ah>")
ENUMERATOR = "<enumerator>"
#: Fixed value: the ASCII punctuation marks, as ranges.
PUNCTUATION = "[!-/:-@\\[-`{-~]"


def text_or_empty(c: Column) -> Column:
    """Null, and the word "nan" that a missing cell leaves behind, as an empty text."""
    return F.when(c.isNull() | (F.lower(F.trim(c)) == "nan"), "").otherwise(c)


def is_blank(c: Column) -> Column:
    return c.isNull() | (F.regexp_replace(c, SPACES, "") == "")


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, f"^{SPACES}+|{SPACES}+$", "")


def squeeze(c: Column) -> Column:
    return strip(F.regexp_replace(c, f"{SPACES}+", " "))


#: Every character that composition may change, or that may join one before it, is in here.
COMPOSABLE = "[^\\x00-\\x{2FF}\\x{2002}-\\x{2125}]"


def composed(c: Column) -> Column:
    """NFC. Only texts with a character that composition may change reach the Arrow function; others are null there."""

    def nfc(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))

    return F.coalesce(F.pandas_udf(nfc, "string")(F.when(F.regexp_like(c, F.lit(COMPOSABLE)), c)), c)


def normalize(c: Column, compose: bool = True) -> Column:
    """Lower case, letters, digits, underscores and apostrophes only, single spaces; null gives ''.

    ``compose=False`` is for text known to be composed: the expression then stays native.
    """
    c = F.coalesce(c, F.lit(""))
    return squeeze(F.regexp_replace(F.lower(composed(c) if compose else c), OUTSIDE, " "))


def normalize_ascii(c: Column) -> Column:
    """The older normaliser: lower case, ASCII punctuation to spaces, single spaces."""
    return squeeze(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), PUNCTUATION, " "))


def tokens(c: Column) -> Column:
    """Words between white space; none for null or blank text."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), f"{SPACES}+"), lambda t: t != "")


def clean(c: Column) -> Column:
    """The manifest cleaner: printable ASCII without tags, digits and marks, lower case.

    The order counts: tabs are deleted and so join words, and a hyphen is deleted, not spaced.
    A bracket without its counterpart takes the word next to it along, spaces or not.
    """
    c = F.regexp_replace(F.coalesce(c, F.lit("")), "[\\r\\n]+", " ")
    c = F.regexp_replace(c, "[^\\x20-\\x7E]", "")
    c = F.regexp_replace(F.regexp_replace(c, " *< *", " <"), " *> *", "> ")
    c = F.regexp_replace(c, "<[^>]*>", " ")
    c = F.array_join(F.filter(F.split(c, " +"), lambda t: ~t.rlike("[<>]")), " ")
    c = F.regexp_replace(c, "[,.'0-9?!`\"-]", "")
    return F.lower(F.trim(F.regexp_replace(c, " +", " ")))


def add_vowel(c: Column) -> Column:
    """Each word whose first letter is a consonant, and that does not end in a, gets an a appended."""
    return F.regexp_replace(c, "(?<!\\S)(?=[^\\sa-zA-Z]*[b-df-hj-np-tv-zB-DF-HJ-NP-TV-Z])(\\S*[^\\saA])(?!\\S)", "$1a")


def adjust_letters(text: Column, item_type: Column) -> Column:
    """:func:`add_vowel` for letter items, other rows as they are."""
    return F.when(F.lower(item_type).contains("letter"), add_vowel(text)).otherwise(text)


def without_fillers(label: Column) -> Column:
    """A label without filler tags; null if it is blank, all fillers, or the enumerator's."""
    kept = F.array_join(F.filter(tokens(label), lambda t: ~F.lower(t).isin(*FILLERS)), " ")
    return F.when((F.lower(strip(label)) != ENUMERATOR) & (kept != ""), kept)


def mistakes(tags: Column) -> Column:
    """A tag sequence with every error as x and everything else as c; gaps count as right."""
    return F.translate(tags, "sid-", "xxxc")


def mistakes_keeping_gaps(tags: Column) -> Column:
    return F.translate(tags, "sid", "xxx")


def scoring_text(c: Column, lowercase: bool = False, separate_marks: bool = False, drop_marks: bool = False, marks: str = ".,?") -> Column:
    """Options of offline scoring: set punctuation apart, lower the case, drop punctuation."""
    some = "[" + "".join("\\" + m for m in marks) + "]"
    if separate_marks:
        c = squeeze(F.regexp_replace(c, f"({some})", " $1 "))
    if lowercase:
        c = F.lower(c)
    if drop_marks:
        c = squeeze(F.regexp_replace(c, some, ""))
    return c
