"""Column helpers shared by the operators: white-space words and hashes of word n-grams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The only white space these operators know, in Java's pattern language.
SPACE_RUN = r"[\x20\x09-\x0D]+"


def whole(text: Column | str) -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def flattened(text: Column) -> Column:
    """The text with every white space character as a space (plain replacements cost less than a pattern)."""
    for character in "\t\n\x0b\x0c\r":
        text = F.replace(text, F.lit(character), F.lit(" "))
    return text


def words(text: Column) -> Column:
    """The maximal runs without white space, in order."""
    return F.array_remove(F.split(flattened(text), " "), "")


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once, however often ``use`` names it."""
    return F.transform(F.array(value), use)[0]


def joined_hashes(hashes: Column, step: int) -> Column:
    """From hashes of n-grams at each position, those of the n-grams ``step`` words longer.

    An n-gram and the one ``step`` positions on overlap or touch, so their pair stands for the longer one.
    The last ``step`` positions have no partner and are cut off.
    """
    return bound(
        hashes,
        lambda h: F.slice(
            F.transform(h, lambda x, i: F.xxhash64(x, F.get(h, i + step))),
            1,
            F.greatest(F.size(h) - F.lit(step), F.lit(0)),
        ),
    )


def unclashed(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without columns that would clash with those an operator adds."""
    taken = {name.lower() for name in names}
    return df.drop(*[c for c in df.columns if c.lower() in taken])
