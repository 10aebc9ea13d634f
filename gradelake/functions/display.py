"""Number formats for report tables (F11). Display only; compare numbers instead."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: Above this a double has too few binary places left for ties at three decimals to matter.
_LARGE = float(1 << 50)


def fixed(c: Column, digits: int) -> Column:
    """A fixed number of decimals, three at most: the exact binary value, rounded half up.

    A plain format would round the shortest decimal that reads back as the same double. The
    fraction is split in two parts, each of which is exact after scaling by a power of ten.
    """
    power = 10 ** digits
    value = c.cast("double")
    size = F.abs(value)
    whole = F.floor(size)
    part = size - whole
    high = F.floor(part * float(1 << 26)) / F.lit(float(1 << 26))
    scaled, low = high * power, (part - high) * power
    below = F.floor(scaled)
    places = below + ((scaled - below - 0.5) >= -low).cast("bigint")
    shown = F.concat(
        F.when(value < 0, "-").otherwise(""),
        (whole + (places == power).cast("bigint")).cast("string"),
        F.concat(F.lit("."), F.lpad((places % power).cast("string"), digits, "0"))
        if digits else F.lit(""),
    )
    return F.when(size < _LARGE, shown).otherwise(F.format_string(f"%.{digits}f", value))


def score(c: Column) -> Column:
    return F.when(c.isNotNull(), fixed(c, 3))


def whole(c: Column) -> Column:
    """Milliseconds and MiB."""
    return F.when(c.isNotNull(), fixed(c, 0))


def rate(c: Column) -> Column:
    return F.when(c.isNotNull(), fixed(c, 1))


def signed_percent(c: Column) -> Column:
    sign = F.when(c >= 0, "+").otherwise("")
    return F.when(c.isNotNull(), F.concat(sign, fixed(c, 1)))


def with_spread(value: Column, low: Column, high: Column, fmt, missing: str = "-") -> Column:
    """``value (low..high)``; the spread is hidden when there is none."""
    flat = low.isNull() | high.isNull() | ((high - low) < 1e-9)
    shown = F.concat(fmt(value), F.lit(" ("), fmt(low), F.lit(".."), fmt(high), F.lit(")"))
    return (
        F.when(value.isNull(), F.lit(missing)).when(flat, fmt(value)).otherwise(shown)
    )


def short_digest(c: Column) -> Column:
    return F.left(c, F.lit(12))
