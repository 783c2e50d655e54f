"""Expressions over version-1 UUIDs (100 ns ticks since 1582-10-15).

Every function takes and returns Spark columns and stays inside whole-stage codegen. A null
input gives null; text that isn't a UUID gives null too (``try_`` conversions only).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ticks between 1582-10-15 and 1970-01-01, and the low words that bound a millisecond.
EPOCH_TICKS = 122192928000000000
LOW_START = "8080808080808080"
LOW_END = "7f7f7f7f7f7f7f7f"
LOW_MIDDLE = "0000000000000000"


def bare(text: Column) -> Column:
    """Lower-case text without braces, hyphens and blanks, as in `digits` but unchecked.

    The usual spelling is cut at its known places, which costs a fraction of `translate`.
    """
    usual = F.concat(*[F.substring(text, p, n) for p, n in ((1, 8), (10, 4), (15, 4), (20, 4), (25, 12))])
    is_usual = (F.length(text) == 36) & (F.substring(text, 9, 1) == "-") & (F.substring(text, 24, 1) == "-")
    return F.lower(F.when(is_usual, usual).otherwise(F.translate(text, "{}- \t", "")))


def is_digits(d: Column) -> Column:
    """Whether bare text is 32 hex digits."""
    return (F.length(d) == 32) & F.unhex(d).isNotNull()


def digits(text: Column) -> Column:
    """The 32 lower-case hex digits of a UUID in any spelling (case, braces, hyphens, blanks); null for other text."""
    d = bare(text)
    return F.when(is_digits(d), d)


def _word(hex_digits: Column) -> Column:
    """An unsigned word of up to 15 hex digits, as bigint."""
    return F.conv(hex_digits, 16, 10).cast("bigint")


def ticks(text: Column) -> Column:
    """The 60-bit tick count."""
    return ticks_of_digits(digits(text))


def ticks_of_digits(d: Column) -> Column:
    """The tick count from normalised digits: time_hi without version, time_mid, time_low."""
    return _word(F.concat(F.substring(d, 14, 3), F.substring(d, 9, 4), F.substring(d, 1, 8)))


def low_word(d: Column) -> Column:
    """The low 64 bits (clock sequence and node) of normalised digits, as 8 bytes."""
    return F.unhex(F.substring(d, 17, 16))


def canonical(text: Column) -> Column:
    """Lower-case text with hyphens."""
    return hyphenated(digits(text))


def hyphenated(d: Column) -> Column:
    return F.concat_ws("-", F.substring(d, 1, 8), F.substring(d, 9, 4), F.substring(d, 13, 4), F.substring(d, 17, 4), F.substring(d, 21, 12))


def from_parts(tick: Column, low: Column) -> Column:
    """Canonical text from a tick count and the 8 low bytes."""
    hi = F.lpad(F.lower(F.hex(tick)), 15, "0")
    lo = F.lower(F.hex(low))
    return F.concat(F.substring(hi, 8, 8), F.lit("-"), F.substring(hi, 4, 4), F.lit("-1"), F.substring(hi, 1, 3), F.lit("-"), F.substring(lo, 1, 4), F.lit("-"), F.substring(lo, 5, 12))


def int_div(a: Column, b: int) -> Column:
    """Bigint division toward zero."""
    return F.call_function("div", a, F.lit(b).cast("bigint"))


def micros(tick: Column) -> Column:
    """Microseconds since 1970, truncated toward zero."""
    return int_div(tick - F.lit(EPOCH_TICKS), 10)


def millis(tick: Column) -> Column:
    """Milliseconds since 1970, truncated toward zero (the date of a change)."""
    return int_div(micros(tick), 1000)


def ticks_of_millis(ms: Column) -> Column:
    """First tick of a millisecond."""
    return ms * F.lit(10000) + F.lit(EPOCH_TICKS)


def ticks_of_micros(us: Column) -> Column:
    return us * F.lit(10) + F.lit(EPOCH_TICKS)


# Milliseconds of the units that a moment can be moved by.
UNITS = {"millis": 1, "seconds": 1000, "minutes": 60_000, "hours": 3_600_000, "days": 86_400_000}


def plus(ms: Column, amount: Column | int, unit: str) -> Column:
    """A moment in milliseconds, moved by an amount of a unit; an unknown unit raises."""
    if unit not in UNITS:
        raise ValueError(f"unknown unit {unit!r}")
    return ms + (F.lit(amount) if isinstance(amount, int) else amount).cast("bigint") * F.lit(UNITS[unit])


def _bound(tick: Column, low: str) -> Column:
    h = F.lpad(F.lower(F.hex(tick)), 15, "0")
    return F.concat(F.substring(h, 8, 8), F.lit("-"), F.substring(h, 4, 4), F.lit("-1"), F.substring(h, 1, 3), F.lit(f"-{low[:4]}-{low[4:]}"))


def start_of(ms: Column) -> Column:
    """Smallest UUID of a millisecond."""
    return _bound(ticks_of_millis(ms), LOW_START)


def end_of(ms: Column) -> Column:
    """Largest UUID of a millisecond: the last tick before the next one."""
    return _bound(ticks_of_millis(ms + F.lit(1)) - F.lit(1), LOW_END)


def middle_of(ms: Column) -> Column:
    """A UUID half a millisecond in."""
    return _bound(ticks_of_millis(ms) + F.lit(5000), LOW_MIDDLE)
