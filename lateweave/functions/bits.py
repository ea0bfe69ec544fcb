"""Bit layouts of quantised residuals as SQL expressions: values and bytes are least significant bit first."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def check_range(values: Column, nbits: int) -> Column:
    """The array itself; an error if an entry is outside 0 .. 2**nbits - 1."""
    bad = F.exists(values, lambda x: (x < 0) | (x >= 1 << nbits))
    return F.when(bad, F.raise_error(F.lit(f"values must be in 0..{(1 << nbits) - 1}")).cast("array<int>")).otherwise(values)


def bit_planes(values: Column, nbits: int) -> Column:
    """All bits of an array of small integers, nbits for each value."""
    return F.flatten(F.transform(check_range(values, nbits), lambda x: F.array(*[F.shiftright(x, b).bitwiseAND(F.lit(1)) for b in range(nbits)])))


def from_planes(bits: Column, nbits: int) -> Column:
    at = F.sequence(F.lit(0), (F.size(bits) / nbits).cast("int") - 1)
    return F.transform(at, lambda i: sum((F.get(bits, i * nbits + b) * (1 << b) for b in range(1, nbits)), F.get(bits, i * nbits)))


def pack_hex(bits: Column) -> Column:
    """Bytes of an array of bits, as hexadecimal text; its length must be a multiple of 8."""
    n = F.size(bits)
    whole = F.when(n % 8 != 0, F.raise_error(F.lit("the number of bits must be a multiple of 8")).cast("int")).otherwise(n)
    at = F.sequence(F.lit(0), (whole / 8).cast("int") - 1)
    return F.array_join(F.transform(at, lambda i: F.lpad(F.hex(sum((F.get(bits, i * 8 + b) * (1 << b) for b in range(1, 8)), F.get(bits, i * 8))), 2, "0")), "")


def pack(bits: Column) -> Column:
    return F.unhex(pack_hex(bits))


def unpack(data: Column) -> Column:
    """The bits of a BINARY column."""
    text = F.hex(data)
    at = F.sequence(F.lit(0), F.octet_length(data) - 1)
    values = F.transform(at, lambda i: F.conv(F.substring(text, i * 2 + 1, F.lit(2)), 16, 10).cast("int"))
    return F.flatten(F.transform(values, lambda x: F.array(*[F.shiftright(x, b).bitwiseAND(F.lit(1)) for b in range(8)])))
