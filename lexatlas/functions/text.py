"""Column expressions over text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD, LETTERS = r"([\p{L}\p{N}_]{2,})", r"(\p{L}{2,})"
#: Words of fewer letters bound a keyword; they are mostly grammar in the languages at hand.
LEAST_LETTERS = 4


def words(text: str | Column, pattern: str = WORD) -> Column:
    """The words of a text in order, as typed."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(1))


def counted_form(text: str) -> Column:
    """Words of two letters or digits at least, in lower case, one space apart."""
    return F.array_join(words(F.lower(text)), " ")


def singular(word: Column) -> Column:
    """A rough key that is one for singular and plural in English and French: the first ending that fits is replaced."""
    cut = lambda n: F.substring(word, F.lit(1), F.length(word) - n)
    return (
        F.when(word.endswith("eaux"), cut(1))
        .when(word.endswith("aux"), F.concat(cut(2), F.lit("l")))
        .when(word.endswith("ies"), F.concat(cut(3), F.lit("y")))
        .when(word.endswith("s") & ~word.endswith("ss") & (F.length(word) > 3), cut(1))
        .otherwise(word)
    )


def length_bonus(score: Column, n_words: Column, alpha: float = 2.0) -> Column:
    """A score raised for longer terms."""
    return score * (1 + alpha * (n_words - 1))


def grams(text: str) -> Column:
    """Keywords of a text: words of LEAST_LETTERS letters, and two such words in a row."""
    w = words(F.lower(text), LETTERS)
    long = lambda x: F.length(x) >= LEAST_LETTERS
    two = F.zip_with(F.slice(w, F.lit(1), F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, F.lit(2), F.greatest(F.size(w) - 1, F.lit(0))), lambda a, b: F.when(long(a) & long(b), F.concat_ws(" ", a, b)))
    return F.concat(F.filter(w, long), F.filter(two, lambda x: x.isNotNull()))
