"""Value modifiers: a space-separated set in, one or more new columns out.

Each modifier is a function ``Column -> {suffix: Column}``; NULL gives NULL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Modifier = Callable[[Column], dict[str, Column]]

# Feature names of the Czech tag sets, and where a lemma ends.
TAG_NAMES = ["SubPOS", "Gen", "Num", "Cas", "PGe", "PNu", "Per", "Ten", "Gra", "Neg", "Voi", "Var", "Sem"]
POSITIONAL_NAMES = ["MainPOS", "SubPOS", "Gen", "Num", "Cas", "PGe", "PNu", "Per", "Ten", "Gra", "Neg", "Voi", "Var"]
POSITIONAL_PLACES = [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 15]
TAG_LENGTH = 15
LEMMA_END = r"(-|`|_;|_:|_,|_\^).*$"


def members(value: Column) -> Column:
    return F.split(value, " ")


def joined(values: Column) -> Column:
    """Array back to text; no members at all is NULL."""
    return F.when(F.size(values) > 0, F.array_join(values, " "))


def lemma_cs_trunc(value: Column) -> dict[str, Column]:
    return {"Trunc": joined(F.transform(members(value), lambda v: F.regexp_replace(v, LEMMA_END, "")))}


def pos_feats_cs(value: Column) -> dict[str, Column]:
    """``name=value`` pairs split by ``|``; a repeated name keeps both values."""

    def found(name: str) -> Column:
        pattern = F.lit(rf"(?:^|\|){name}=([^|]*)")
        return F.flatten(F.transform(members(value), lambda v: F.regexp_extract_all(v, pattern, F.lit(1))))

    return {name: joined(found(name)) for name in TAG_NAMES}


def pos_feats_cs_positional(value: Column) -> dict[str, Column]:
    full = F.filter(members(value), lambda v: F.length(v) == TAG_LENGTH)

    def at(place: int) -> Column:
        return joined(F.transform(full, lambda v: F.substring(v, place, 1)))

    return {name: at(place) for name, place in zip(POSITIONAL_NAMES, POSITIONAL_PLACES)}


def pos_feats_cs_trunc(value: Column) -> dict[str, Column]:
    full = F.filter(members(value), lambda v: F.length(v) == TAG_LENGTH)
    return {"Trunc": joined(F.transform(full, lambda v: F.substring(v, 1, 2)))}


def pos_first_char(value: Column) -> dict[str, Column]:
    """First character of each member; tags of any length count."""
    full = F.filter(members(value), lambda v: F.length(v) >= 1)
    return {"First": joined(F.transform(full, lambda v: F.substring(v, 1, 1)))}


def sempos_trunc(value: Column) -> dict[str, Column]:
    return {
        "Trunc1": joined(F.transform(members(value), lambda v: F.substring_index(v, ".", 1))),
        "Trunc2": joined(F.transform(members(value), lambda v: F.substring_index(v, ".", 2))),
    }
