"""Text helpers as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as ECMAScript has it.
SPACE = r"[\t-\r\x20\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"
PLUMBING = ("<command-", "<local-command", "<bash-", "<task-notification")
NOT_A_LABEL = ("<", "Caveat:", "This session is being continued")


def trimmed(x: Column) -> Column:
    """The text without white space at its ends; only one that has some there is searched as a whole."""
    ends = F.concat(F.left(x, F.lit(1)), F.right(x, F.lit(1)))
    return F.when(ends.rlike(SPACE), F.regexp_replace(x, rf"\A{SPACE}+|{SPACE}+\z", "")).otherwise(x)


def one_line(x: Column) -> Column:
    return trimmed(F.regexp_replace(x, f"{SPACE}+", " "))


def shortened(x: Column, most: int = 60) -> Column:
    """The text, or its first `most` - 3 characters and an ellipsis."""
    return F.when(F.char_length(x) > most, F.concat(F.substring(x, 1, most - 3), F.lit("…"))).otherwise(x)


def any_prefix(x: Column, prefixes: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | x.startswith(p)
    return out


def is_plumbing(x: Column) -> Column:
    return any_prefix(x, PLUMBING)


def label_worthy(x: Column) -> Column:
    return (F.length(x) > 0) & ~is_plumbing(x) & ~any_prefix(x, NOT_A_LABEL)


def number(x: Column) -> Column:
    """Text as a finite number, else 0."""
    n = F.when(F.length(trimmed(x)) > 0, trimmed(x).try_cast("double")).otherwise(0.0)
    return F.when(F.isnan(n) | n.isNull() | (F.abs(n) == float("inf")), 0.0).otherwise(n)
