"""Text forms of values, operation names and retry delays, as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rillfold.functions.timeuuid import int_div

# The codes of log operations.
OPERATIONS = ["PRE_IMAGE", "ROW_UPDATE", "ROW_INSERT", "ROW_DELETE", "PARTITION_DELETE", "ROW_RANGE_DELETE_INCLUSIVE_LEFT_BOUND", "ROW_RANGE_DELETE_EXCLUSIVE_LEFT_BOUND", "ROW_RANGE_DELETE_INCLUSIVE_RIGHT_BOUND", "ROW_RANGE_DELETE_EXCLUSIVE_RIGHT_BOUND", "POST_IMAGE"]


def operation_name(code: Column) -> Column:
    """Name of an operation; null for null; an unknown code raises."""
    c = code.cast("int")
    known = F.try_element_at(F.array(*map(F.lit, OPERATIONS)), c + 1)
    return F.when(c.isNull(), F.lit(None).cast("string")).when(c.between(0, 9), known).otherwise(F.raise_error(F.concat(F.lit("unknown operation "), c.cast("string"))).cast("string"))


def _units(amount: Column, units: list[tuple[int, str]]) -> Column:
    """Digits and unit for each unit that the rest holds at least once."""
    parts, rest = [], amount
    for size, name in units:
        parts.append(F.when(rest >= size, F.concat(int_div(rest, size).cast("string"), F.lit(name))).otherwise(F.lit("")))
        rest = rest % F.lit(size).cast("bigint")
    return F.concat(*parts)


def duration(months: Column, days: Column, nanos: Column) -> Column:
    """`1y2mo3d4h5m6s7ms8us9ns`, a leading minus if any part is negative, empty if all are zero."""
    m, d, n = (x.cast("bigint") for x in (months, days, nanos))
    sign = F.when((m < 0) | (d < 0) | (n < 0), F.lit("-")).otherwise(F.lit(""))
    day = [(3_600_000_000_000, "h"), (60_000_000_000, "m"), (1_000_000_000, "s"), (1_000_000, "ms"), (1000, "us"), (1, "ns")]
    return F.concat(sign, _units(F.abs(m), [(12, "y"), (1, "mo")]), _units(F.abs(d), [(1, "d")]), _units(F.abs(n), day))


def date(c: Column) -> Column:
    return F.date_format(c, "y-MM-dd")


def timestamp(ms: Column) -> Column:
    """`dd/MM/yyyy, HH:mm:ss.SSS` of milliseconds since 1970."""
    return F.date_format(F.timestamp_millis(ms), "dd/MM/yyyy, HH:mm:ss.SSS")


def value(c: Column, kind: str) -> Column:
    """Text of a field: blobs as 0x and hex, null as the word."""
    text = F.concat(F.lit("0x"), F.lower(F.hex(c))) if kind == "binary" else c.cast("string")
    return F.coalesce(text, F.lit("null"))


def raw(c: Column, kind: str) -> Column:
    """The bytes in which a value travels: whole numbers and moments big-endian in their width, text as UTF-8, UUIDs as 16 bytes; null for null."""
    width = {"boolean": 1, "tinyint": 1, "smallint": 2, "int": 4, "bigint": 8}
    if kind in width:
        return F.unhex(F.substring(F.lpad(F.hex(c.cast("bigint")), 16, "0"), 17 - 2 * width[kind], 2 * width[kind]))
    if kind == "timestamp":
        return raw(F.unix_millis(c.cast("timestamp")), "bigint")
    if kind == "uuid":
        return F.unhex(F.translate(c, "-", ""))
    if kind in ("string", "binary"):
        return c.cast("binary")
    raise ValueError(f"no bytes for {kind}")


def field(text: Column, width: int) -> Column:
    """Right-aligned in `width` characters; longer text loses its end."""
    return F.lpad(F.substring(text, 1, width), width, " ")


def backoff_ms(attempt: Column, base_ms: int, max_ms: int) -> Column:
    """Delay before a retry without jitter: doubled for each attempt, up to a limit."""
    doubling = F.lit(base_ms).cast("double") * F.pow(F.lit(2.0), attempt.cast("double"))
    return F.least(F.lit(max_ms).cast("double"), doubling).cast("bigint")


def jittered_ms(delay: Column, jitter: float, max_jitter_ms: int, seed: int | None = None) -> Column:
    """The delay less a random share of it, at most `max_jitter_ms`."""
    return (delay - F.least(F.rand(seed) * delay * F.lit(jitter), F.lit(float(max_jitter_ms)))).cast("bigint")
