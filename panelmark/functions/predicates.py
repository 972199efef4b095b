"""Filters: competition scopes, dates, seasons, names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Competition types of each scope; None is no filter.
SCOPES: dict[str, tuple[int, ...] | None] = {
    "all": None,
    "nqs": (10,),
    "sectionals_and_championships": (1, 2, 3, 4, 5, 6, 7, 8, 9),
    "championships_only": (4, 8),
    "spd_sectionals": (1, 2, 3),
    "sys_sectionals": (5, 6, 7, 9),
    "international": (15, 16, 17),
    "isu_event": (15, 16),
}


def scope(kind: Column, name: str) -> Column:
    """Raises KeyError for an unknown scope. `qualifying`: a type that is neither non-qualifying nor an international championship type."""
    if name == "qualifying":
        return kind.isNotNull() & (kind != 11) & ~kind.isin(15, 16, 17)
    types = SCOPES[name]
    return F.lit(True) if types is None else kind.isin(*types)


def event_date(start: Column, end: Column) -> Column:
    return F.coalesce(start, end)


def in_dates(date: Column, first: str | None = None, last: str | None = None) -> Column:
    """Inclusive; a null date fails only where a bound is given."""
    out = F.lit(True)
    if first:
        out = out & (date >= F.lit(first).cast("date"))
    if last:
        out = out & (date <= F.lit(last).cast("date"))
    return out


def any_of(column: Column, values: Sequence | None) -> Column:
    """None is no filter, an empty list lets nothing pass."""
    return F.lit(True) if values is None else column.isin(*values) if values else F.lit(False)


def narrowed(marks: DataFrame, scope_name: str = "all", first: str | None = None, last: str | None = None, seasons: Sequence[int] | None = None, disciplines: Sequence[int] | None = None) -> DataFrame:
    """All filters that W1 has in common, combined by and."""
    own = scope(F.col("competition_type_id"), scope_name) & in_dates(F.col("event_date"), first, last)
    return marks.where(own & any_of(F.col("season_start"), seasons or None) & any_of(F.col("discipline_type_id"), disciplines))


def event_pattern(levels: Sequence[str], disciplines: Sequence[str]) -> str:
    """A pattern that a name must match: one of the levels and one of the disciplines, anywhere, in any case."""
    more = {"Senior": ("Senior", "Championship"), "Singles": ("Women", "Men", "Girls", "Boys", "Ladies", "Lady", "Single", "Singles")}
    ahead = lambda names: "(?=.*(?:" + "|".join(x for n in names for x in more.get(n, (n,))) + "))" if names else ""
    return f"(?i){ahead(levels)}{ahead(disciplines)}.*"


def is_number(text: Column) -> Column:
    return text.rlike("^[0-9]+$")
