"""Scalar helpers over columns: all built-in expressions, so they stay in whole-stage codegen."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(c: Column) -> Column:
    """Without leading and trailing white space of any kind."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def dedup_hash(title: Column, company: Column, location: Column) -> Column:
    """First 16 hexadecimal digits of SHA-256 over the three fields, lower case and stripped."""
    return F.substring(F.sha2(F.concat_ws("|", *[strip(F.lower(F.coalesce(c, F.lit("")))) for c in (title, company, location)]), 256), 1, 16)


def midpoint(low: Column, high: Column) -> Column:
    """Mean of both where both are given and not 0, else the one that is."""
    return F.when((low != 0) & (high != 0), (low + high) / 2).otherwise(F.coalesce(F.nullif(high, F.lit(0)), low))


def salary_display(low: Column, high: Column) -> Column:
    pounds = lambda c: F.concat(F.lit("£"), F.format_number(c, 0))
    has_low, has_high = F.coalesce(low != 0, F.lit(False)), F.coalesce(high != 0, F.lit(False))
    return (
        F.when(has_low & has_high, F.concat(pounds(low), F.lit("–"), pounds(high)))
        .when(has_low, F.concat(F.lit("From "), pounds(low)))
        .when(has_high, F.concat(F.lit("Up to "), pounds(high)))
        .otherwise("Not disclosed")
    )


def week_start(ts: Column) -> Column:
    """The Monday of the timestamp's week, as a date."""
    return F.date_trunc("week", ts).cast("date")


def iso_week(ts: Column) -> Column:
    """ISO year and week as year:week."""
    return F.concat_ws(":", F.extract(F.lit("YEAROFWEEK"), ts).cast("int").cast("string"), F.lpad(F.weekofyear(ts).cast("string"), 2, "0"))


def nearest_rank(n: Column, percent: int) -> Column:
    """1-based position of a percentile by floor nearest-rank among n sorted values."""
    return F.greatest(F.lit(1), F.floor(n * percent / 100)).cast("int")


def split_list(c: Column, separator: str = ",") -> Column:
    """Items of a separated list, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(c, separator), lambda x: F.trim(x)), lambda x: x != "")


def any_keyword(c: Column, words: Iterable[str]) -> Column:
    """Is any of the literal words in the column's lower case?"""
    low = F.lower(c)
    out = F.lit(False)
    for w in words:
        out = out | low.contains(w.lower())
    return out


def level(c: Column, spellings: dict[str, str]) -> Column:
    table = F.create_map(*[F.lit(x) for kv in spellings.items() for x in kv])
    return F.coalesce(table[F.lower(c)], F.lower(c))


def client_ip(forwarded: Column, peer: Column) -> Column:
    """The last entry of a forwarding header, or the peer's address."""
    return F.coalesce(F.nullif(F.trim(F.element_at(F.split(forwarded, ","), -1)), F.lit("")), peer)
