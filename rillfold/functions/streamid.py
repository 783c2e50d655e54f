"""Expressions over 16-byte stream ids. Null or short ids give null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: flips the sign bit of every byte but the first, so a signed 64-bit comparison orders words by signed bytes.
SIGN_FLIP = 0x0080808080808080


def hex_id(stream: Column) -> Column:
    """Lower-case hex of a binary id."""
    return F.lower(F.hex(stream))


def word(hex_text: Column, pos: int) -> Column:
    """The signed 64-bit word whose 16 hex digits start at 1-based `pos`."""
    half = lambda p: F.conv(F.substring(hex_text, p, 8), 16, 10).cast("bigint")
    return F.shiftleft(half(pos), 32).bitwiseOR(half(pos + 8))


def order_keys(hex_text: Column) -> tuple[Column, Column]:
    """Two bigints whose order is the order of the id by signed bytes."""
    flip = F.lit(SIGN_FLIP)
    return word(hex_text, 1).bitwiseXOR(flip), word(hex_text, 17).bitwiseXOR(flip)


def vnode(hex_text: Column) -> Column:
    """The 22-bit vnode index above the four version bits of the low word."""
    low = F.conv(F.substring(hex_text, 25, 8), 16, 10).cast("bigint")
    return F.shiftright(low.bitwiseAND(F.lit(0x3FFFFF0)), 4).cast("int")
