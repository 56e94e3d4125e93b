"""Bit and code-length expressions over BIGINT columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def popcount(x: Column) -> Column:
    return F.bit_count(x).cast("int")


def highest_bit(x: Column) -> Column:
    """Position of the highest set bit of a positive number, 0 for 0."""
    return F.when(x > 0, F.length(F.bin(x)) - 1).otherwise(0).cast("int")


def lowest_bit(x: Column) -> Column:
    """Position of the lowest set bit, 0 for 0."""
    return F.when(x != 0, F.bit_count(x.bitwiseXOR(x - 1)) - 1).otherwise(0).cast("int")


def select_in_word(x: Column, k: int) -> Column:
    """Position of the k-th set bit (from 1), counted from the lowest; null if there are fewer."""
    digits = F.reverse(F.bin(x))
    ones = F.filter(F.sequence(F.lit(0), F.length(digits) - 1), lambda i: F.substring(digits, i + 1, F.lit(1)) == "1")
    return F.get(ones, F.lit(k - 1))


def pattern_count(x: Column, pattern: str) -> Column:
    """Overlapping occurrences of a two-bit pattern (as written, high bit first) in the binary digits."""
    return F.regexp_count(F.bin(x), F.lit(f"(?={pattern})")).cast("int")


def gamma_length(x: Column) -> Column:
    """Bits of the Elias gamma code of x >= 1."""
    return 2 * highest_bit(x) + 1


def delta_length(x: Column) -> Column:
    """Bits of the Elias delta code of x >= 1."""
    n = highest_bit(x)
    return n + gamma_length((n + 1).cast("long"))


def fibonacci_length(x: Column) -> Column:
    """Bits of the Fibonacci code of x >= 1: the largest Fibonacci number (1, 2, 3, 5, ...) not above x, plus the closing bit."""
    fib = [1, 2]
    while fib[-1] < 1 << 62:
        fib.append(fib[-1] + fib[-2])
    return (F.size(F.filter(F.array(*map(F.lit, fib)), lambda f: f <= x)) + 1).cast("int")


def reversed_word(x: Column, width: int = 64) -> Column:
    """The lowest ``width`` bits in reverse order, as a string of binary digits."""
    return F.reverse(F.lpad(F.substring(F.bin(x), -width, width), width, "0"))


def gamma_code(x: Column) -> Column:
    """The Elias gamma code of x >= 1 as binary digits: as many zeros as digits follow the first, then the number."""
    digits = F.bin(x)
    return F.concat(F.repeat(F.lit("0"), F.length(digits) - 1), digits)


def gamma_value(code: Column) -> Column:
    """The number of a gamma code."""
    zeros = F.length(F.regexp_extract(code, "^0*", 0))
    return F.conv(F.substring(code, zeros + 1, zeros + 1), 2, 10).cast("long")
