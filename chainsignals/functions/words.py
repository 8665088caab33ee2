"""256-bit words as hexadecimal text: doubles and exact decimal text."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


#: Hexadecimal digits in order (fixed value).
HEX = "0123456789abcdef"


def hex_data(data: Column) -> Column:
    """Lower-case hex digits of log data, with or without 0x."""
    return F.lower(F.regexp_replace(data, "^0[xX]", ""))


def word(digits: Column, i: int) -> Column:
    """The i-th 32-byte word of hex digits."""
    return F.substring(digits, 1 + 64 * i, 64)


def word_address(digits: Column, i: int) -> Column:
    return F.concat(F.lit("0x"), F.right(word(digits, i), F.lit(40)))


def halves(w: Column) -> tuple[Column, Column]:
    """Low and high 128 bits of a packed word, as whole words."""
    return F.lpad(F.substring(w, 33, 32), 64, "0"), F.lpad(F.substring(w, 1, 32), 64, "0")


def flexible_int(x: Column) -> Column:
    """A number given in decimal or as 0x hex."""
    text = x.cast("string")
    return F.when(text.rlike("^0[xX]"), F.conv(F.substring(text, 3, 64), 16, 10).cast("bigint")).otherwise(text.cast("bigint"))


def _limb(digits: Column, k: int) -> Column:
    """The k-th unsigned 64-bit limb, highest first, as decimal text; most limbs are zero."""
    part = F.substring(digits, 1 + 16 * k, 16)
    return F.when(part == "0" * 16, F.lit("0")).otherwise(F.conv(part, 16, 10))


def to_double(w: Column, signed: Column) -> Column:
    """The value of a word as a double; null words and words cut short give null.

    A negative word is minus its complement and one more: the one is added to the lowest
    limb, before it is rounded.
    """
    negative = signed & (F.substring(w, 1, 1) >= "8")
    digits = F.when(negative, F.translate(w, HEX, HEX[::-1])).otherwise(w)
    low = F.when(negative, (_limb(digits, 3).cast("decimal(20,0)") + 1).cast("double")).otherwise(_limb(digits, 3).cast("double"))
    size = low
    for k, scale in ((2, 2.0**64), (1, 2.0**128), (0, 2.0**192)):
        size = size + _limb(digits, k).cast("double") * scale
    return F.when(F.length(w) == 64, F.when(negative, -size).otherwise(size))


def to_decimal_text(w: Column, signed: bool = False) -> Column:
    """The exact value of a word as decimal text (a 256-bit number fits no decimal type)."""

    @F.pandas_udf("string")
    def convert(words: pd.Series) -> pd.Series:
        def one(x: str | None) -> str | None:
            if x is None:
                return None
            n = int(x, 16)
            return str(n - 2**256 if signed and n >> 255 else n)

        return words.map(one)

    return convert(w)
