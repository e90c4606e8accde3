"""Text expressions that stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that count as white space, and the punctuation
# that survives special-character removal besides word characters.
SPACE = r"\p{IsWhite_Space}\x1c-\x1f"
KEPT_PUNCTUATION = r""".,;:!?()\[\]{}"'-"""

SPACES = f"[{SPACE}]+"
DROPPED = rf"[^\p{{L}}\p{{N}}_{SPACE}{KEPT_PUNCTUATION}]"


def strip(text: Column) -> Column:
    """Remove white space of any kind from both ends."""
    return F.regexp_replace(text, f"^{SPACES}|{SPACES}$", "")


def words(text: Column) -> Column:
    """The white-space separated tokens, without empty ones."""
    return F.filter(F.split(text, SPACES), lambda word: word != "")


def first_words(text: Column, limit: int) -> Column:
    """At most ``limit`` leading tokens, joined by one blank."""
    return F.array_join(F.slice(words(text), 1, limit), " ")


def squeeze(text: Column) -> Column:
    """Every run of white space becomes one blank; the ends are cut."""
    return F.array_join(words(text), " ")


def drop_special(text: Column) -> Column:
    """Keep word characters, white space and common punctuation."""
    return F.regexp_replace(text, DROPPED, "")
