"""Column helpers for strings and numbers."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def bigram(left: Column, right: Column, sep: str = " ") -> Column:
    """Join two members; an empty member keeps its separator, a NULL one goes."""
    return F.concat_ws(sep, left, right)


def ngrams(rows: Column, width: int, sep: str = " ") -> Column:
    """Element-wise join of an array of equally long string arrays.

    NULL rows are skipped; with no rows every element is the empty string.
    """
    present = F.filter(rows, lambda r: r.isNotNull())

    def member(j: int) -> Column:
        return F.coalesce(F.array_join(F.transform(present, lambda r: F.get(r, F.lit(j))), sep), F.lit(""))

    return F.array(*[member(j) for j in range(width)])


def safe_substr(s: Column, start: int, end: int) -> Column:
    """Characters ``start`` to ``end`` (0-based, end excluded), short if need be."""
    return F.substring(s, start + 1, end - start)


def match_pattern(s: Column, pattern: str) -> Column:
    """The part matched by the single ``*`` of ``pre*post``; NULL if no match."""
    return match_patterns(s, re.sub(r"\*+|\$[0-9]", "*", pattern, count=1), 1)[0]


def match_patterns(s: Column, pattern: str, limit: int | None = None) -> list[Column]:
    """One column per variable (``*``, ``**`` or ``$1``..``$9``) of the pattern."""
    pieces = re.split(r"\*+|\$[0-9]", pattern, maxsplit=limit or 0)
    regex = "(?s)^" + "(.*)".join(_quote(p) for p in pieces) + "$"
    return [F.when(s.rlike(regex), F.regexp_extract(s, regex, i)) for i in range(1, len(pieces))]


def _quote(text: str) -> str:
    return re.sub(r"([\\.\[\]{}()*+?^$|])", r"\\\1", text)


def natural_order(name: Column) -> Column:
    """Sort key under which digits at the end compare as a number."""
    return F.struct(
        F.regexp_extract(name, "^(.*?)([0-9]*)$", 1).alias("prefix"),
        F.when(name.rlike("[0-9]$"), F.regexp_extract(name, "([0-9]+)$", 1).cast("decimal(38,0)")).alias("number"),
    )


def log2(x: Column) -> Column:
    return F.log2(x)


def argmax(values: Column) -> Column:
    """0-based position of the first largest element."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def sequence(start: Column, stop: Column) -> Column:
    return F.sequence(start, stop)


def combinations(values: Column, k: int, sep: str = " ") -> Column:
    """All k-subsets of a string array, in order, each joined by ``sep``."""
    if k == 0:
        return F.array(F.lit(""))
    if k == 1:
        return values
    return F.flatten(
        F.transform(
            values,
            lambda v, i: F.transform(
                combinations(F.slice(values, i + 2, F.size(values)), k - 1, sep),
                lambda rest: F.concat_ws(sep, v, rest),
            ),
        )
    )


def number_text(x: Column) -> Column:
    """A double as text, without a trailing ``.0``."""
    return F.regexp_replace(x.cast("string"), r"\.0$", "")
