"""Column expressions: parsing, cleaning, transforms, labels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_date(raw: Column) -> Column:
    """A date from a spreadsheet serial (days since 1899-12-30) or an ISO string; error markers ``#...`` give null."""
    text = F.trim(raw.cast("string"))
    serial = F.expr("date'1899-12-30'")
    days = text.try_cast("double").cast("int")
    return F.when(text.startswith("#"), None).otherwise(F.coalesce(F.date_add(serial, days), text.try_cast("date"), F.try_to_timestamp(text).cast("date")))


def clean_number(raw: Column) -> Column:
    """A double; text that is no number, NaN and the infinities give null."""
    x = raw.try_cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def clean_text(raw: Column) -> Column:
    """Lower case, white space (no-break spaces too) collapsed and trimmed."""
    return F.lower(F.trim(F.regexp_replace(raw, r"[\s ]+", " ")))


def flag_tokens(flags: Column) -> Column:
    return F.regexp_extract_all(F.lower(flags), F.lit("[a-z]+"), F.lit(0))


def convert(price: Column, fx: Column, per: float = 1.0) -> Column:
    """A price in another currency and unit: divided by the exchange rate and by the units it is quoted per."""
    return F.try_divide(price, fx * F.lit(per))


def to_state(x: Column, transform: str) -> Column:
    """What a model sees of a level: its log (``logdiff``), a share of 100 (``percent_rate_diff``) or itself (``diff``).

    A log of what is not positive is null.
    """
    if transform == "logdiff":
        return F.when(x > 0, F.log(x))
    return x / 100 if transform == "percent_rate_diff" else x


def from_state(x: Column, transform: str) -> Column:
    if transform == "logdiff":
        return F.exp(x)
    return x * 100 if transform == "percent_rate_diff" else x


def share_or_unsplit(part: Column, whole: Column) -> tuple[Column, Column]:
    """part / whole within 0 and 1, and 1.0 instead in the second column where the share can't be told."""
    told = part.isNotNull() & whole.isNotNull() & (whole > 0)
    return F.when(told, F.greatest(F.lit(0.0), F.least(F.lit(1.0), part / whole))).otherwise(0.0), F.when(told, 0.0).otherwise(1.0)


def seasonal_dummies(date: Column, omitted: int = 12) -> list[Column]:
    return [F.when(F.month(date) == m, 1.0).otherwise(0.0).alias(f"m{m:02d}") for m in range(1, 13) if m != omitted]


def regime(z: Column, cuts: Sequence[float] = (1.0, 0.5, -0.5, -1.0), labels: Sequence[str] = ("very high", "high", "normal", "low", "very low")) -> Column:
    out = F.lit(labels[-1])
    for cut, label in reversed(list(zip(cuts, labels, strict=False))):
        out = F.when(z >= cut, label).otherwise(out)
    return F.when(z.isNotNull(), out)


def identity(uri: Column) -> dict[str, Column]:
    """The parts of ``forecast://model/vintage/run/name``."""
    parts = F.split(F.regexp_replace(uri, "^[a-z]+://", ""), "/")
    return {name: F.get(parts, F.lit(i)) for i, name in enumerate(("model_id", "vintage", "run_id", "forecast_name"))}


def alias_of(name: Column, aliases: Mapping[str, str]) -> Column:
    """The name an alias stands for, else the name itself."""
    pairs = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])
    return F.coalesce(F.try_element_at(pairs, name), name)


def signature(*columns: str) -> Column:
    """SHA-256 of a row's columns as JSON."""
    return F.sha2(F.to_json(F.struct(*columns)), 256)


def signed(x: Column, digits: int = 2) -> Column:
    return F.format_string(f"%+.{digits}f", x)


def interval_text(low: Column, high: Column, digits: int = 2) -> Column:
    return F.format_string(f"%.{digits}f to %.{digits}f", low, high)


def horizon_rule(origin: Column, months: Column, weekly: bool = False) -> Column:
    """Periods to forecast so as to reach the end of the ``months``-th month, the origin's counting as the first.

    Three months at least; for weeks, the Mondays after the origin, 26 at least.
    """
    if not weekly:
        return F.greatest(F.lit(3), months)
    first = F.next_day(origin, "Mon")
    last = F.last_day(F.add_months(F.trunc(origin, "month"), months - 1))
    return F.greatest(F.lit(26), F.floor(F.datediff(last, first) / 7).cast("int") + 1)
