"""Column helpers shared by all operators.  Everything here stays a built-in expression."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

DRAW_SIZE = 4294967296  # draws are integers in [0, 2^32)


def hash_draw(key: Column, salt: str) -> Column:
    """Repeatable uniform draw: the first 8 hex digits of md5(key | salt) as an integer.

    Unlike ``rand()`` it gives the same value on a retried task and in every run.
    """
    digest = F.md5(F.concat_ws("|", key.cast("string"), F.lit(salt)))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def draw_between(key: Column, salt: str, low: int, high: int) -> Column:
    """Draw an integer in [low, high]."""
    return F.lit(low) + F.pmod(hash_draw(key, salt), F.lit(high - low + 1))


def draw_decimal(key: Column, salt: str, low: str, high: str, places: int, precision: int) -> Column:
    """Draw a decimal in [low, high] on a grid of ``places`` decimals."""
    unit = 10**places
    first, last = round(float(low) * unit), round(float(high) * unit)
    return (draw_between(key, salt, first, last) / F.lit(float(unit))).cast(f"decimal({precision},{places})")


def by_position(index: Column, values: Sequence[str], kind: str = "string") -> Column:
    """The ``index``-th of a short fixed list (0-based)."""
    return F.element_at(fixed_list(values, kind), (index + 1).cast("int"))


def fixed_list(values: Sequence[str], kind: str = "string") -> Column:
    """Array literal of fixed values, built in one call."""
    texts = [str(v).replace("\\", "\\\\").replace("'", "\\'") for v in values]
    return F.expr(f"array({', '.join(f"CAST('{t}' AS {kind})" for t in texts)})")


def money(value: Column) -> Column:
    return value.cast("decimal(18,2)")


def fixed(value: Column, places: int) -> Column:
    """Round half away from zero on a decimal view of ``value``, returned as a double.

    Rounding a binary double directly depends on its last bit; rounding a DECIMAL(38,10) does not.
    """
    return F.round(value.cast("decimal(38,10)"), places).cast("double")


def ratio(numerator: Column, denominator: Column, places: int, scale: float = 1.0) -> Column:
    """``numerator / denominator * scale`` rounded; NULL when the denominator is 0 or NULL."""
    share = numerator.cast("double") / F.nullif(denominator.cast("double"), F.lit(0.0))
    return fixed(share * F.lit(float(scale)), places)


def millis_between(first: Column, second: Column) -> Column:
    """Millisecond boundaries crossed from ``first`` to ``second``."""
    return F.unix_millis(second) - F.unix_millis(first)


def attribute(variant: Column, key: str, kind: str = "string") -> Column:
    """Value under a literal key, dots included.  ``$.a.b`` would be read as a path."""
    return F.try_variant_get(variant, f'$["{key}"]', kind)


def whole_number(text: Column) -> Column:
    """Text to BIGINT, rounding decimals and giving NULL for anything that is no number."""
    return text.try_cast("decimal(38,0)").try_cast("bigint")


def match_group(text: Column, pattern: str, group: int = 1) -> Column:
    """First match of a regular expression group, NULL when there is none."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def is_weekend(day: Column) -> Column:
    """Friday to Sunday."""
    return F.dayofweek(day).isin(6, 7, 1)


def day(value: dt.date | str) -> Column:
    return F.lit(value).cast("date")


def as_date(value: dt.date | str | None) -> dt.date:
    if value is None:
        return dt.date.today()
    return value if isinstance(value, dt.date) else dt.date.fromisoformat(value)


def since(as_of: dt.date | str | None, days: int) -> Column:
    """First day of a window reaching ``days`` back from ``as_of``."""
    return F.lit(as_date(as_of) - dt.timedelta(days=days))
