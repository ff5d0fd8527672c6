"""Base62 numbers and time-ordered short keys, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the digits, in ASCII order, so that keys of one width sort as their numbers do.
ALPHABET = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
TIME_WIDTH, TAIL_WIDTH = 9, 4
_LONG_DIGITS = 11  # 62**11 > 2**63


def _digit(number: Column, place: int) -> Column:
    # from the number itself, so that an expression grows with the digits and not with their square
    return F.substring(F.lit(ALPHABET), (F.call_function("div", number.cast("long"), F.lit(62**place).cast("long")) % 62 + 1).cast("int"), F.lit(1))


def encode_base62(number: Column) -> Column:
    """A non-negative long as Base62 without leading zeros; null for null."""
    return F.concat(F.ltrim(F.concat(*(_digit(number, k) for k in range(_LONG_DIGITS - 1, 0, -1))), F.lit("0")), _digit(number, 0))


# Checks are added as 0 to what they check: outside of a condition, an expression that is used several times is computed
# once, and a row's code stays small enough for the JVM to compile. Functions that take a lambda aren't compiled at all.


def _zero_unless(wrong: Column, message: Column) -> Column:
    return F.when(wrong, F.raise_error(message).cast("long")).otherwise(F.lit(0).cast("long"))


def decode_base62(text: Column) -> Column:
    """The long that a Base62 string stands for; an error for other characters and for more than a long, null for null."""
    digits = F.lpad(F.ltrim(text, F.lit("0")), _LONG_DIGITS + 1, "0")  # a longer number overflows in these already
    number = _zero_unless(~text.rlike(r"\A[0-9A-Za-z]+\z"), F.concat(F.lit("not Base62: "), text))
    for k in range(1, _LONG_DIGITS + 2):
        number = number * 62 + (F.position(F.substring(digits, k, 1), F.lit(ALPHABET)).cast("long") - 1)
    return number


def short_key(millis: Column, counter: Column, process: int = 4242, salt: Column | None = None) -> Column:
    """A 13-character key: nine digits of the time in milliseconds, four of (counter XOR process) plus a salt."""
    tail = (counter.cast("long").bitwiseAND(F.lit(0xFFFFFF)).bitwiseXOR(F.lit(process & 0xFFFF))) + (F.lit(0) if salt is None else salt)
    return F.concat(F.lpad(encode_base62(millis.cast("long")), TIME_WIDTH, "0"), *(_digit(tail, k) for k in range(TAIL_WIDTH - 1, -1, -1)))


def key_time(key: Column) -> Column:
    """The time of a short key, as a timestamp; an error for keys under nine characters."""
    return F.timestamp_millis(_zero_unless(F.length(key) < TIME_WIDTH, F.lit("the key is too short")) + decode_base62(F.substring(key, 1, TIME_WIDTH)))


def crc32_hex(text: Column) -> Column:
    """The CRC-32 of a string's UTF-8 bytes as ``0x`` and eight upper-case digits."""
    return F.format_string("0x%08X", F.crc32(F.encode(text, "UTF-8")))


def number_of(value: Column) -> Column:
    """A loose number: null and blank strings are 0, booleans 0 or 1, other strings null unless they are numbers."""
    text = F.trim(value.cast("string"))
    return F.when(value.isNull() | (text == ""), F.lit(0.0)).when(text == "true", F.lit(1.0)).when(text == "false", F.lit(0.0)).otherwise(text.try_cast("double"))
