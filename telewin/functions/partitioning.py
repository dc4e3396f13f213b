"""The partition a producer gives a record: a hash of its serialized key.

The hash is MurmurHash2 of 32 bits with the seed that producers use. It is worked out in
bigints that hold unsigned 32-bit numbers; a product with the multiplier, which is below 2**31,
stays below 2**63.
"""

from pyspark.sql import Column, functions as F

from telewin.functions.bound import bound

# Fixed values of the hash.
SEED = 0x9747B28C
MULTIPLIER = 0x5BD1E995
SHIFT = 24
LAST_SHIFTS = (13, 15)

_MASK = 0xFFFFFFFF
_POSITIVE = 0x7FFFFFFF


def _times(number: Column) -> Column:
    return (number * F.lit(MULTIPLIER)).bitwiseAND(F.lit(_MASK))


def _folded(number: Column, bits: int) -> Column:
    return number.bitwiseXOR(F.shiftright(number, bits))


def _word(digits: Column, i: Column) -> Column:
    """Four bytes, from their hex digits, as a number, the first byte being the greatest."""
    return F.conv(F.rpad(F.substring(digits, F.shiftleft(i, 3) + 1, F.lit(8)), 8, "0"), 16, 10).cast("bigint")


def _swapped(number: Column) -> Column:
    """The four bytes of a number in the opposite order."""
    low = F.shiftleft(number.bitwiseAND(F.lit(0xFF)), 24) + F.shiftleft(number.bitwiseAND(F.lit(0xFF00)), 8)
    high = F.shiftright(number, 8).bitwiseAND(F.lit(0xFF00)) + F.shiftright(number, 24)
    return low + high


def murmur2(data: Column) -> Column:
    """The hash of bytes as an unsigned 32-bit number; null for null.

    The hex digits of the bytes and each step are bound before they are named again, so that a key is
    encoded once for all its words.
    """

    def hashed(digits: Column) -> Column:
        length = F.shiftright(F.length(digits), 1)
        words = F.shiftright(length, 2)
        each = F.when(words > 0, F.sequence(F.lit(0), words - 1)).otherwise(F.array().cast("array<int>"))
        numbers = F.transform(each, lambda i: _word(digits, i))
        numbers = F.transform(numbers, lambda number: _times(_swapped(number)))

        def with_word(so_far: Column, number: Column) -> Column:
            return _times(so_far).bitwiseXOR(_times(_folded(number, SHIFT)))

        start = F.lit(SEED).cast("bigint").bitwiseXOR(length.cast("bigint"))
        whole = F.aggregate(numbers, start, with_word)

        def finished(number: Column) -> Column:
            """The bytes after the last whole word."""
            tail = bound(_word(digits, words), lambda rest: _times(number.bitwiseXOR(_swapped(rest))))
            return F.when(length > F.shiftleft(words, 2), tail).otherwise(number)

        last = bound(whole, finished)
        last = bound(last, lambda number: _times(_folded(number, LAST_SHIFTS[0])))
        return bound(last, lambda number: _folded(number, LAST_SHIFTS[1]))

    return bound(F.hex(data), hashed)


def key_partition(key_bytes: Column, partitions: int) -> Column:
    """Where a producer puts a record with this serialized key; records without a key have no fixed place."""
    positive = murmur2(key_bytes).bitwiseAND(F.lit(_POSITIVE))
    return F.pmod(positive, F.lit(partitions)).cast("int")
