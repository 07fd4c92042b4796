"""Column expressions shared by the operators. Everything stays inside code generation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS_PER_DAY = 86_400_000_000

# Month abbreviations of the Portuguese month labels.
MONTHS_PT = ["Jan", "Fev", "Mar", "Abr", "Mai", "Jun", "Jul", "Ago", "Set", "Out", "Nov", "Dez"]


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def money(c: Column | str) -> Column:
    """Exact cents, so that sums do not depend on how rows are partitioned."""
    return _col(c).cast("decimal(18,2)")


def number(c: Column | str) -> Column:
    return _col(c).cast("double")


def exact_mean(total: Column, count: Column) -> Column:
    """Mean from an exact total; null when nothing was counted."""
    return F.try_divide(total.cast("double"), count)


def whole_days(start: Column | str, end: Column | str) -> Column:
    """Elapsed 24-hour periods, rounded down also below zero (not calendar days)."""
    micros = F.timestamp_diff("MICROSECOND", _col(start), _col(end))
    return ((micros - F.pmod(micros, F.lit(MICROS_PER_DAY))) / MICROS_PER_DAY).cast("int")


def months_between_months(first: Column | str, later: Column | str) -> Column:
    """Difference of calendar months, whatever the day of the month."""
    first, later = _col(first), _col(later)
    return (F.year(later) - F.year(first)) * 12 + (F.month(later) - F.month(first))


def month_key(ts: Column | str) -> Column:
    return F.date_format(_col(ts), "yyyy-MM")


def weekday_from_monday(ts: Column | str) -> Column:
    return F.weekday(_col(ts))


def half_even(c: Column | str, digits: int) -> Column:
    """Round to ``digits`` places the way numpy does: scale, round half to even, unscale."""
    scale = float(10**digits)
    return F.rint(_col(c) * scale) / scale


def half_up(c: Column | str, digits: int) -> Column:
    """Round to ``digits`` places the way a SQL ``ROUND`` on doubles does."""
    scale = float(10**digits)
    return F.round(_col(c) * scale, 0) / scale


def safe_ratio(numerator: Column | str, denominator: Column | str) -> Column:
    """Null instead of an error when the denominator is zero."""
    return F.try_divide(_col(numerator), _col(denominator))


def at_least(c: Column | str, floor: float) -> Column:
    """Clip from below; null stays null."""
    return F.when(_col(c).isNotNull(), F.greatest(_col(c), F.lit(floor)))


def title_words(c: Column | str) -> Column:
    """``garden_tools`` becomes ``Garden Tools``."""
    return F.initcap(F.replace(_col(c), F.lit("_"), F.lit(" ")))


def to_number(c: Column | str) -> Column:
    """Text to double; what is not a number becomes null."""
    return _col(c).try_cast("double")


def to_moment(c: Column | str) -> Column:
    """Text to timestamp; what is not a date becomes null."""
    return _col(c).try_cast("timestamp_ntz")


def text_or_nan(c: Column | str) -> Column:
    """Text for category features and exports, where a missing value is the text ``nan``."""
    return F.coalesce(_col(c).cast("string"), F.lit("nan"))


def banded(c: Column | str, upper_bounds: Sequence[float], labels: Sequence[str]) -> Column:
    """Label by the first bound that is not exceeded; the last label takes the rest.

    Null takes the last label too, as no comparison with null holds.
    """
    value = _col(c)
    chain = F.when(value <= F.lit(upper_bounds[0]), F.lit(labels[0]))
    for bound, label in zip(upper_bounds[1:], labels[1:]):
        chain = chain.when(value <= F.lit(bound), F.lit(label))
    return chain.otherwise(F.lit(labels[len(upper_bounds)]))


def last_closed_month(latest: Column | str) -> Column:
    """Last day of the latest month that the data covers to its end."""
    day = F.to_date(_col(latest))
    return F.when(day < F.last_day(day), F.last_day(F.add_months(day, -1))).otherwise(
        F.last_day(day)
    )


def month_label_pt(key: Column | str) -> Column:
    """``2018-01`` becomes ``Jan/18``."""
    names = F.array(*[F.lit(m) for m in MONTHS_PT])
    key = _col(key)
    return F.concat(
        F.element_at(names, F.substring(key, 6, 2).cast("int")), F.lit("/"), F.substring(key, 3, 2)
    )


def half_year(month: Column | str) -> Column:
    """``2018-03`` becomes ``2018-S1``."""
    month = _col(month)
    half = F.when(F.substring(month, 6, 2) <= "06", "-S1").otherwise("-S2")
    return F.concat(F.substring(month, 1, 4), half)
