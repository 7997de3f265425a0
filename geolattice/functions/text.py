"""ASCII-folding text match Columns."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

from .geo import lit

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
SPACES = "[ \\t\\n\\r\\f\\x0B]+"


def ascii_lower(c) -> Column:
    return F.translate(lit(c), UPPER, LOWER)


def ascii_upper(c) -> Column:
    return F.translate(lit(c), LOWER, UPPER)


def tokens(c) -> Column:
    """Non-empty whitespace-separated runs."""
    return F.filter(F.split(lit(c), SPACES), lambda t: t != "")


def fold_title(c) -> Column:
    """ASCII fold, runs of whitespace to one space, ends trimmed."""
    return F.array_join(tokens(ascii_lower(c)), " ")


def match_quality(query, candidate) -> Column:
    """0 exact, 1 prefix, 2 every query word starts some word, -1 no match; an empty query is 0."""
    q, c = ascii_lower(query), ascii_lower(candidate)
    qt, ct = tokens(q), tokens(c)
    trimmed = F.array_join(qt, " ")
    every = F.forall(qt, lambda t: F.exists(ct, lambda w: w.startswith(t)))
    return (F.when((F.size(qt) == 0) | (c == trimmed), 0).when(c.startswith(trimmed), 1)
            .when(every, 2).otherwise(-1))


def contains_text(cells: list[Column], typed) -> Column:
    """Any cell holds the typed text, ASCII case-insensitively."""
    joined = F.concat_ws("\u0001", *[c.cast("string") for c in cells])
    return ascii_lower(joined).contains(ascii_lower(typed))
