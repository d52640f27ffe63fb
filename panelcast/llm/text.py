"""Words, lines and counts as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The characters that end a word.
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
SPACE_RUN = r"[\x20\x09-\x0D]+"


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body mentions it."""
    return F.transform(F.array(value), body)[0]


def whole(text: Column | str) -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def without(text: Column, characters: str) -> Column:
    for character in characters:
        text = F.replace(text, F.lit(character), F.lit(""))
    return text


def count_of(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(without(text, characters))


def words(text: Column) -> Column:
    """Runs of characters other than the six ASCII spaces."""
    return bind(
        F.btrim(text, F.lit(SPACES)),
        lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(
            F.split(t, SPACE_RUN, -1)
        ),
    )


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def lower_ascii(text: Column) -> Column:
    """A-Z lowered, everything else as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fresh_name(frame: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``frame`` has it."""
    taken = {c.lower() for c in frame.columns}
    while name.lower() in taken:
        name += "_"
    return name
