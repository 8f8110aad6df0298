"""Column expressions over names of people."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Accented letters of Latin script and what they are without, one for one; letters that become two are replaced before.
ACCENTED, BARE = "àáâãäåçèéêëìíîïñòóôõöøùúûüýÿł", "aaaaaaceeeeiiiinoooooouuuuyyl"
DOUBLE = {"ß": "ss", "æ": "ae", "œ": "oe"}


def folded(name: str | Column) -> Column:
    """A name in lower case without accents and signs, with single spaces; commas stay."""
    x = F.lower(name)
    for a, b in DOUBLE.items():
        x = F.replace(x, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(F.translate(x, ACCENTED, BARE), r"[^a-z,]+", " "))


def parts(name: str | Column) -> Column:
    """The words of a name, surname last: what stands before a comma goes to the end."""
    x = folded(name)
    turned = F.when(F.contains(x, F.lit(",")), F.concat_ws(" ", F.substring_index(F.regexp_replace(x, r"^[^,]*,", ""), ",", 1), F.substring_index(x, ",", 1))).otherwise(x)
    return F.filter(F.split(turned, " +"), lambda w: w != "")


def bag(name: str | Column) -> Column:
    """The words of a name in alphabetical order, so that order doesn't count."""
    return F.array_join(F.array_sort(parts(name)), " ")


def agreement(a: Column, b: Column) -> Column:
    """How two names (arrays of words, surname last) agree: same, order, initials, part, or null."""
    size = lambda x: F.size(x)
    last = F.element_at(a, -1) == F.element_at(b, -1)
    begins = lambda x, y: x.startswith(y) | y.startswith(x)
    first = begins(F.element_at(a, 1), F.element_at(b, 1)) & ((F.length(F.element_at(a, 1)) == 1) | (F.length(F.element_at(b, 1)) == 1))
    return (
        F.when((size(a) == 0) | (size(b) == 0), F.lit(None))
        .when(a == b, "same")
        .when(F.array_sort(a) == F.array_sort(b), "order")
        .when(last & first, "initials")
        .when((F.size(F.array_except(a, b)) == 0) | (F.size(F.array_except(b, a)) == 0), "part")
    )
