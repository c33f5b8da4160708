"""Search over the steps of all runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIELDS = ("label", "tool_name", "input", "output", "data_payload")


def snippet(text: Column, needle: str, before: int = 30, after: int = 50) -> Column:
    """The surroundings of the needle's first place, with an ellipsis at a cut end; null if it isn't there."""
    return snippet_of(text, F.lit(needle), before, after)


def snippet_of(text: Column, needle: Column, before: int = 30, after: int = 50) -> Column:
    """snippet() of a needle in a column."""
    at = F.call_function("locate", F.lower(needle), F.lower(text))
    first = F.greatest(F.lit(1), at - before)
    last = F.least(F.char_length(text), at + F.char_length(needle) - 1 + after)
    cut = F.concat(F.when(first > 1, "…").otherwise(""), F.substring(text, first, last - first + 1), F.when(last < F.char_length(text), "…").otherwise(""))
    return F.when(at > 0, cut)


def search(steps: DataFrame, needle: str, limit: int | None = 50, fields: tuple[str, ...] = FIELDS, order: tuple = ("run_id", "index")) -> DataFrame:
    """Rows (run_id, index, field, snippet): each matching step by its first matching field, in any case.

    limit: the report's length, taken in order without a full sort.
    """
    hit = F.coalesce(*[F.when(F.contains(F.lower(F.col(f)), F.lit(needle.lower())), F.struct(F.lit(f).alias("field"), snippet(F.col(f), needle).alias("snippet"))) for f in fields])
    found = steps.select("run_id", "index", hit.alias("hit"), *[c for c in order if c not in ("run_id", "index") and isinstance(c, str)]).where("hit is not null")
    found = found.orderBy(*order).limit(limit) if limit is not None else found
    return found.select("run_id", "index", "hit.field", "hit.snippet")
