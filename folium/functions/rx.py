"""Builders of patterns for Java's regex engine, where Unicode classes and case folding must be asked for."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def unicode_ci(pattern: str) -> str:
    return f"(?iU){pattern}"


def stems(words: list[str]) -> str:
    """Any of the words at a left word boundary, longest first, so that stems match their inflections."""
    by_length = sorted(words, key=lambda w: (-len(w), words.index(w)))
    return unicode_ci(r"\b(?:" + "|".join(re.escape(w).replace(r"\ ", " ") for w in by_length) + ")")


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once, however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


#: A non-character: single characters split without a regex engine, which split() would build anew for each row.
SEPARATOR = "\uffff"


def parts(c: Column, pattern: str) -> Column:
    """The pieces of a text between the matches of a pattern, empty ones included."""
    return F.split(F.regexp_replace(F.translate(c, SEPARATOR, " "), pattern, SEPARATOR), SEPARATOR, -1)
