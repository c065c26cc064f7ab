"""Text columns: whitespace, words, accents, tokens.

Word and space characters are spelled out: Java's ``\\w`` and ``\\s`` are ASCII by default and, with
the Unicode flag, slower and wider (``\\w`` then takes in combining marks).
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

WORD = r"\p{L}\p{N}_"

# White space. The Latin-1 part is written as single characters, which a regular
# expression tests with one table look-up; the rest lies between U+1680 and U+3000.
SPACE = r" \t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85\xa0"
WIDE_SPACE = r"\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SPACE_CHARS = (
    " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# Accented vowels and their plain form; ñ is kept.
ACCENTED = "áéíóúüÁÉÍÓÚÜ"
PLAIN = "aeiouuAEIOUU"

_PLAIN_OF = str.maketrans(ACCENTED, PLAIN)


def narrow_space(c: Column) -> Column:
    """Replace the rare white space outside Latin-1 by blanks, in texts that may hold any."""
    return F.when(c.rlike(r"[\u1680-\u3000]"), F.regexp_replace(c, f"[{WIDE_SPACE}]", " ")).otherwise(c)


def strip_space(c: Column) -> Column:
    """Trim every kind of white space from both ends."""
    return F.trim(c, F.lit(SPACE_CHARS))


def squeeze(c: Column) -> Column:
    """Collapse white space to single blanks and trim; names its argument once, as lambdas need."""
    return F.trim(F.regexp_replace(c, rf"[{SPACE}{WIDE_SPACE}]+", " "))


def words(c: Column) -> Column:
    """Maximal runs of non-space characters."""
    return F.regexp_extract_all(narrow_space(c), F.lit(rf"[^{SPACE}]+"), F.lit(0))


def word_count(c: Column) -> Column:
    return F.array_size(words(c)).cast("long")


def is_multiword(c: Column) -> Column:
    """More than one word; stops reading at the second."""
    any_space = SPACE + WIDE_SPACE
    return c.rlike(f"[^{any_space}][{any_space}]+[^{any_space}]")


def is_single_word(c: Column) -> Column:
    return ~is_multiword(c) & c.rlike(f"[^{SPACE}{WIDE_SPACE}]")


def contains_word(c: Column, word: str) -> Column:
    """The word occurs with no letter, number or underscore on either side, in any case.

    The left side is checked behind the word, so the search runs on the word's characters.
    """
    return c.rlike(rf"(?iu)\Q{word}\E(?![{WORD}])(?<![{WORD}]\Q{word}\E)")


def strip_accents(c: Column) -> Column:
    return F.translate(c, ACCENTED, PLAIN)


def normalize(c: Column) -> Column:
    """Lower case, no accents, nothing but word characters and white space."""
    return F.regexp_replace(strip_accents(F.lower(c)), rf"[^{WORD}{SPACE}{WIDE_SPACE}]", "")


def plain_stopwords(stopwords: Iterable[str]) -> list[str]:
    return sorted({w.translate(_PLAIN_OF) for w in stopwords})


def spanish_stopwords(spark: SparkSession) -> list[str]:
    """Spark's Spanish list, the default where the caller brings none."""
    from pyspark.ml.feature import StopWordsRemover

    spark.sparkContext  # the list lives in the JVM, so a session must exist
    return StopWordsRemover.loadDefaultStopWords("spanish")


def tokens(c: Column, stopwords: Iterable[str], min_chars: int = 3) -> Column:
    """The content words of a text: alphabetic, long enough and not a stopword, after normalising.

    A normalised text holds only word characters and white space, so one pattern finds the runs of
    letters that fill a whole word; no token is looked at again but for the stopwords.
    """
    whole = rf"(?<![{WORD}])\p{{L}}{{{min_chars},}}+(?![{WORD}])"
    found = F.regexp_extract_all(normalize(c), F.lit(whole), F.lit(0))
    stop = plain_stopwords(stopwords)
    return F.filter(found, lambda t: ~t.isin(stop)) if stop else found
