"""Bit fields of binary payloads as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _latin(data: Column) -> Column:
    return F.decode(data, "ISO-8859-1")


def byte_at(data: Column, index: Column) -> Column:
    """Unsigned byte at a 0-based index."""
    return F.ascii(F.substring(_latin(data), index.cast("int") + 1, F.lit(1))).cast("long")


def n_bytes(bit_offset: Column, length_bits: Column) -> Column:
    return F.ceil((bit_offset + length_bits) / 8).cast("int")


def fits(data: Column, byte_offset: Column, bit_offset: Column, length_bits: Column) -> Column:
    return byte_offset + n_bytes(bit_offset, length_bits) <= F.length(data)


def _shl(value: Column, n: Column) -> Column:
    return F.call_function("shiftleft", value, n.cast("int"))


def _shr(value: Column, n: Column) -> Column:
    return F.call_function("shiftrightunsigned", value, n.cast("int"))


def low_bits(value: Column, length_bits: Column) -> Column:
    """The lowest ``length_bits`` bits of a 64-bit number."""
    drop = F.greatest(F.lit(64) - length_bits, F.lit(0))
    return _shr(_shl(value, drop), drop)


def words(data: Column) -> Column:
    """Payload as 64-bit words, most significant byte first; the last one is filled up with zeros."""
    text = F.hex(data)
    text = F.rpad(text, (F.ceil(F.length(data) / 8) * 16).cast("int"), "0")

    def word(i: Column) -> Column:
        high = F.conv(F.substring(text, (i * 16 + 1).cast("int"), F.lit(8)), 16, 10).cast("long")
        low = F.conv(F.substring(text, (i * 16 + 9).cast("int"), F.lit(8)), 16, 10).cast("long")
        return _shl(high, F.lit(32)).bitwiseOR(low)

    some = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.length(data) / 8).cast("int") - 1, F.lit(0))), word)
    return F.when(F.length(data) > 0, some).otherwise(F.array().cast("array<bigint>"))


def swap_bytes(word: Column) -> Column:
    """A 64-bit word with its bytes in the opposite order."""
    def mask(n: int) -> Column:
        return F.lit(n).cast("long")

    x = _shl(word.bitwiseAND(mask(0x00FF00FF00FF00FF)), F.lit(8)).bitwiseOR(_shr(word, F.lit(8)).bitwiseAND(mask(0x00FF00FF00FF00FF)))
    y = _shl(x.bitwiseAND(mask(0x0000FFFF0000FFFF)), F.lit(16)).bitwiseOR(_shr(x, F.lit(16)).bitwiseAND(mask(0x0000FFFF0000FFFF)))
    return _shl(y, F.lit(32)).bitwiseOR(_shr(y, F.lit(32)))


def extract_from_words(big: Column, little: Column, length: Column, byte_offset: Column, bit_offset: Column, length_bits: Column, byte_order: Column) -> Column:
    """Bits of a field as a 64-bit number; null where the field runs past ``length`` bytes.

    Little: least significant bit first across bytes. Big: ``bit_offset`` counts from the most
    significant bit, sequentially. A 64-bit field keeps its bit pattern, so its upper half is negative.
    A field lies in one word or two; both are read with shifts.
    """
    at = (byte_offset * 8 + bit_offset).cast("int")
    word, start = F.floor(at / 64).cast("int"), at % 64
    spill = (start + length_bits > 64) & (start > 0)
    zero = F.lit(0).cast("long")
    drop = F.lit(64) - length_bits
    upper = F.when(spill, _shl(F.get(little, word + 1), F.lit(64) - start)).otherwise(zero)
    as_little = _shr(_shl(_shr(F.get(little, word), start).bitwiseOR(upper), drop), drop)
    lower = F.when(spill, _shr(F.get(big, word + 1), F.lit(64) - start)).otherwise(zero)
    as_big = _shr(_shl(F.get(big, word), start).bitwiseOR(lower), drop)
    fit = byte_offset + n_bytes(bit_offset, length_bits) <= length
    return F.when(fit, F.when(byte_order == "little", as_little).otherwise(as_big))


def extract_unsigned(data: Column, byte_offset: Column, bit_offset: Column, length_bits: Column, byte_order: Column) -> Column:
    """The same for one field of a payload."""
    big = words(data)
    return extract_from_words(big, F.transform(words(data), swap_bytes), F.length(data), byte_offset, bit_offset, length_bits, byte_order)


def sign(raw: Column, length_bits: Column, signedness: Column) -> Column:
    """Two's complement of signed fields; others as they are."""
    up = F.when(signedness == "signed", F.lit(64) - length_bits).otherwise(F.lit(0)).cast("int")
    return F.call_function("shiftright", _shl(raw, up), up)


def ieee754(bits: Column, length_bits: Column) -> Column:
    """Value of a 32- or 64-bit IEEE number from its bits."""
    wide = length_bits == 64
    fraction_bits = F.when(wide, 52).otherwise(23)
    exponent = low_bits(_shr(bits, fraction_bits), F.when(wide, 11).otherwise(8))
    fraction = low_bits(bits, fraction_bits).cast("double") / F.pow(F.lit(2.0), fraction_bits)
    top, bias = F.when(wide, 2047).otherwise(255), F.when(wide, 1023).otherwise(127)
    negative = _shr(bits, length_bits - 1) == 1
    size = (
        F.when((exponent == top) & (fraction > 0), F.lit(float("nan")))
        .when(exponent == top, F.lit(float("inf")))
        .when(exponent == 0, fraction * F.pow(F.lit(2.0), 1 - bias))
        .otherwise((1 + fraction) * F.pow(F.lit(2.0), exponent - bias))
    )
    return F.when(negative, -size).otherwise(size)
