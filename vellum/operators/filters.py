"""Predicates, paging and typed getters over any table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def filtered(df: DataFrame, equal: dict | None = None, at_least: dict | None = None, at_most: dict | None = None) -> DataFrame:
    """The conjunction of the given comparisons; None values and unknown columns are left out."""
    for given, compare in ((equal, Column.__eq__), (at_least, Column.__ge__), (at_most, Column.__le__)):
        for name, value in (given or {}).items():
            if value is not None and name in df.columns:
                df = df.where(compare(F.col(name), F.lit(value)))
    return df


def page(df: DataFrame, *order: Column | str, skip: int = 0, limit: int = 100) -> DataFrame:
    """Rows skip .. skip + limit in a total order; a top-k, not a full sort of the output."""
    return df.orderBy(*order).offset(skip).limit(limit)


def newest(df: DataFrame, time: str = "created_at", key: str = "id", skip: int = 0, limit: int = 100) -> DataFrame:
    return page(df, F.desc(time), F.asc(key), skip=skip, limit=limit)


def sorted_page(df: DataFrame, sort_by: str, fallback: str, key: str, descending: bool = True, skip: int = 0, limit: int = 100) -> DataFrame:
    """A page by a column that the caller names, or by the fallback where there is no such column."""
    column = F.col(sort_by if sort_by in df.columns else fallback)
    return page(df, column.desc() if descending else column.asc(), F.asc(key), skip=skip, limit=limit)


def search(df: DataFrame, term: str, *columns: str) -> DataFrame:
    """Rows in which any of the columns contains the term, in any case."""
    found = F.lit(False)
    for name in columns:
        found = found | F.coalesce(F.col(name).cast("string").ilike(f"%{term}%"), F.lit(False))
    return df.where(found)


def by_prefix(df: DataFrame, prefix: str, column: str = "key") -> DataFrame:
    """LIKE prefix%: an underscore in the prefix stands for any character."""
    return df.where(F.col(column).like(f"{prefix}%"))


def within(df: DataFrame, now: str, hours: int, time: str = "created_at") -> DataFrame:
    """Rows of the last hours before a given time; a range on the column, so it is pushed to the scan."""
    return df.where((F.col(time) >= F.expr(f"timestamp_ntz'{now}' - INTERVAL {int(hours)} HOURS")) & (F.col(time) <= F.expr(f"timestamp_ntz'{now}'")))


def on_day(df: DataFrame, day: str, time: str = "created_at") -> DataFrame:
    """date(time) = day, as a range that reaches the scan."""
    start = F.expr(f"timestamp_ntz'{day} 00:00:00'")
    return df.where((F.col(time) >= start) & (F.col(time) < F.expr(f"timestamp_ntz'{day} 00:00:00' + INTERVAL 1 DAY")))


def without_consent(column: str = "data_consent_given") -> Column:
    """False or null."""
    return ~F.coalesce(F.col(column), F.lit(False))


def as_bool(value: Column) -> Column:
    return F.coalesce(F.lower(value).isin("true", "1", "yes", "on"), F.lit(False))


def as_int(value: Column, default: int = 0) -> Column:
    """A whole number in text, else the default."""
    return F.coalesce(F.when(value.rlike("^[+-]?[0-9]+$"), value.try_cast("bigint")), F.lit(default).cast("bigint"))


def as_float(value: Column, default: float = 0.0) -> Column:
    return F.coalesce(F.when(value.rlike(r"^[+-]?[0-9]+(?:\.[0-9]+)?$"), value.try_cast("double")), F.lit(default))


def rollout(user: Column, percent: int, enabled: bool = True) -> Column:
    """Whether a user's stable bucket of 100 lies below the percentage."""
    if percent >= 100 or percent <= 0:
        return F.lit(enabled and percent >= 100)
    bucket = F.conv(F.left(F.md5(user.cast("string").cast("binary")), F.lit(8)), 16, 10).cast("long")
    return F.lit(enabled) & (F.pmod(bucket, F.lit(100)) < percent)


def ratio(a: Column, b: Column, digits: int, scale: float = 1.0) -> Column:
    """scale * a / b rounded; 0 where b is 0 or null."""
    return F.coalesce(F.round(F.try_divide(a.cast("double"), b.cast("double")) * scale, digits), F.lit(0.0))


def percent(a: Column, b: Column, digits: int = 2) -> Column:
    return ratio(a, b, digits, 100.0)
