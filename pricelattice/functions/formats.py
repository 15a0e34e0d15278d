"""Numbers and dates as text. Ties round to even digits, as most languages print them: a tie is one of the double itself, not of the short decimal that names it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The three ways in which dates are shown.
DAY, SHORT_DAY, MINUTE = "dd.MM.yyyy", "dd.MM", "yyyy-MM-dd HH:mm"


def fixed(number: Column, digits: int = 0) -> Column:
    """``12.5`` with so many digits after the point."""
    return F.concat(F.when(number < 0, "-").otherwise(""), _size(number, digits))


def _size(number: Column, digits: int) -> Column:
    """What stands after the sign, which small negative numbers keep."""
    return F.format_string(f"%.{digits}f", _rounded(F.abs(number.cast("double")), digits))


def _rounded(size: Column, digits: int) -> Column:
    """``size`` (0 or more) to up to 8 digits. ``bround`` takes 47.45 for a tie, but the double of that name is a little more, so printing gives 47.5.

    Only where the product with a power of ten comes out at a half may the true one lie beside it; what the product lost, which is exact in halves of 26 bits, tells
    the side. Products of 2^52 or more are left to ``bround``.
    """
    ten = float(10**digits)
    scaled = size * ten
    high = size * (2.0**27 + 1) - (size * (2.0**27 + 1) - size)
    lost = (high * ten - scaled) + (size - high) * ten
    below = F.floor(scaled)
    whole = F.when((scaled - below == 0.5) & (lost != 0), below + (lost > 0).cast("int")).otherwise(F.rint(scaled))
    return F.when(scaled < 2.0**52, whole / ten).otherwise(F.bround(size, digits))


def signed(number: Column, digits: int = 0) -> Column:
    """The same with ``+`` or ``-`` before it."""
    return F.concat(F.when(number < 0, "-").otherwise("+"), _size(number, digits))


def percent(share: Column, digits: int = 1) -> Column:
    """A share as ``12.5%``."""
    return F.concat(fixed(share * 100, digits), F.lit("%"))


def padded(text: Column, width: int) -> Column:
    """``text`` moved to the right of a column of ``width``; longer texts stay whole."""
    return F.concat(F.repeat(F.lit(" "), F.greatest(F.lit(width) - F.length(text), F.lit(0))), text)


def date_text(ts: Column, style: str = DAY) -> Column:
    return F.date_format(ts, style)


def iso_text(ts: Column) -> Column:
    """A time as ISO 8601 text in UTC, with microseconds where it has any."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(ts, "SSSSSS")
    return F.concat(whole, F.when(micros == "000000", F.lit("")).otherwise(F.concat(F.lit("."), micros)), F.lit("+00:00"))


def iso_time(text: Column) -> Column:
    """The time that ISO 8601 text names, as UTC without a zone: with an offset (``+03:00`` or ``Z``) moved by it, without one as it stands; NULL where it names none."""
    t = F.trim(text)
    zone = F.regexp_extract(t, r"(Z|[+-]\d{2}:?\d{2})$", 1)
    plain = F.regexp_replace(t, r"(?:Z|(?<=[T ].{5,30})[+-]\d{2}:?\d{2})$", "").try_cast("timestamp_ntz")
    digits = F.regexp_replace(zone, ":", "")
    minutes = F.when(digits.isin("", "Z"), 0).otherwise(F.concat(F.substring(digits, 1, 1), F.lit("1")).try_cast("int") * (F.substring(digits, 2, 2).try_cast("int") * 60 + F.substring(digits, 4, 2).try_cast("int")))
    return plain - F.make_dt_interval(mins=minutes)
