"""Hex, Base58, bit packing, address texts: built-in expressions, inside whole-stage code generation wherever Spark generates code.

Longs hold unsigned 64-bit values by their bits. ANSI mode may be on: nothing here overflows.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the data model.
BLOCK_SHIFT = 43
AMOUNT_MASK = (1 << BLOCK_SHIFT) - 1
MAX_BLOCK = (1 << 21) - 1
MAX_AMOUNT = 1 << 42
ADDRESS_LENGTH = 65
PREFIX_LENGTH = 8
BASE58_ALPHABET = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
LIMB = (1 << 44) - 1


def fail_if(test: Column, message: str, value: Column) -> Column:
    return F.when(test, F.raise_error(F.lit(message))).otherwise(value)


def unsigned(x: Column) -> Column:
    """The value as DECIMAL(20, 0), for people to read."""
    return F.conv(F.hex(x), 16, 10).cast("decimal(20,0)")


def pack(block: Column, amount: Column) -> Column:
    """block << 43 plus the amount, which is clamped to 2^42; a block over 2^21 - 1 or below 0 is an error."""
    block = block.cast("long")
    packed = F.shiftleft(block, BLOCK_SHIFT).bitwiseOR(F.least(amount.cast("long"), F.lit(MAX_AMOUNT)))
    return fail_if((block > MAX_BLOCK) | (block < 0), "the block number needs more than 21 bits", packed)


def block_of(payload: Column) -> Column:
    return F.shiftrightunsigned(payload, BLOCK_SHIFT)


def amount_of(payload: Column) -> Column:
    return payload.bitwiseAND(F.lit(AMOUNT_MASK))


def to_hex(x: Column, padded: bool = True) -> Column:
    """Lower-case digits: sixteen, or as few as it takes."""
    return F.lower(F.lpad(F.hex(x), 16, "0")) if padded else F.lower(F.hex(x))


def _hex_value(digits: Column) -> Column:
    return F.conv(digits, 16, -10).cast("long")


def try_parse_hex(text: Column) -> Column:
    """One to sixteen digits, either case, after an optional 0x; null for anything else."""
    return F.when(text.rlike(r"\A(0[xX])?[0-9a-fA-F]{1,16}\z"), _hex_value(F.regexp_replace(text, r"\A0[xX]", "")))


def parse_hex(text: Column) -> Column:
    """As try_parse_hex, but other texts are an error; null stays null."""
    return fail_if(text.isNotNull() & try_parse_hex(text).isNull(), "not a hexadecimal 64-bit value", try_parse_hex(text))


def from_hex(text: Column) -> Column:
    """The tolerant parser: leading zeros beyond sixteen digits and ASCII white space around the digits are fine; overflow is an error."""
    digits = F.regexp_replace(F.regexp_replace(text, r"\A0[xX]", ""), r"\A[\t-\r ]+|[\t-\r ]+\z", "")
    ok = digits.rlike(r"\A0*[0-9a-fA-F]{1,16}\z")
    return fail_if(text.isNotNull() & ~ok, "not a hexadecimal 64-bit value", F.when(ok, _hex_value(F.regexp_extract(digits, r"([0-9a-fA-F]{1,16})\z", 1))))


def tx_short_id(txid: Column) -> Column:
    """The first sixteen digits of a transaction id."""
    return from_hex(F.substring(txid, 1, 16))


def address_prefix(address: Column) -> Column:
    """The first eight characters as a little-endian value; fewer are an error. Characters beyond Latin-1 keep their low byte."""
    codes = F.transform(F.sequence(F.lit(1), F.lit(PREFIX_LENGTH)), lambda i: F.ascii(F.substring(address, i, F.lit(1))).cast("long").bitwiseAND(F.lit(255)))
    whole = F.aggregate(F.reverse(codes), F.lit(0).cast("long"), lambda a, c: F.shiftleft(a, 8).bitwiseOR(c))
    plain = F.conv(F.hex(F.reverse(F.substring(address, 1, PREFIX_LENGTH))), 16, -10).cast("long")
    return fail_if(F.char_length(address) < PREFIX_LENGTH, "an address prefix takes eight characters", F.when(F.octet_length(F.substring(address, 1, PREFIX_LENGTH)) == PREFIX_LENGTH, plain).otherwise(whole))


def address_is_valid(address: Column) -> Column:
    """Exactly 65 ASCII characters; null for null."""
    return (F.char_length(address) == ADDRESS_LENGTH) & (F.octet_length(address) == ADDRESS_LENGTH)


def pad_right(text: Column, length: int, filler: str) -> Column:
    """Fills up to length and never cuts."""
    return F.when(F.char_length(text) < length, F.rpad(text, length, filler)).otherwise(text)


def padded_address(text: Column) -> Column:
    return pad_right(text, ADDRESS_LENGTH, "A")


def padded_tx(text: Column) -> Column:
    return pad_right(text, ADDRESS_LENGTH, "T")


def address_with_prefix(prefix: Column, filler: str) -> Column:
    """An address that begins with the prefix: the way to make two with the same first eight characters."""
    return F.rpad(prefix, ADDRESS_LENGTH, filler)


def hex_of_bytes(data: Column) -> Column:
    """Upper-case hex; null and empty give an empty text."""
    return F.coalesce(F.hex(data), F.lit(""))


def _byte_pairs(data: Column) -> Column:
    digits = F.hex(data)
    return F.when(F.length(data) > 0, F.transform(F.sequence(F.lit(1), F.length(data)), lambda i: F.substring(digits, 2 * i - 1, F.lit(2)))).otherwise(F.array().cast("array<string>"))


def reversed_hex(data: Column) -> Column:
    """Lower-case hex of the bytes in reverse; empty is an error."""
    return fail_if(F.length(data) == 0, "no bytes", F.lower(F.array_join(F.reverse(_byte_pairs(data)), "")))


def to_binary_digits(data: Column, little_endian: bool = False, grouped: bool = False) -> Column:
    """Eight binary digits a byte, most significant first; little_endian turns the bytes round, grouped puts spaces between them."""
    pairs = F.reverse(_byte_pairs(data)) if little_endian else _byte_pairs(data)
    return F.array_join(F.transform(pairs, lambda p: F.lpad(F.conv(p, 16, 2), 8, "0")), " " if grouped else "")


def base58_short_id(address: Column) -> Column:
    """Sixteen nibbles, from the sixth on, of the decoded address's bytes in reverse: three of the checksum, then thirteen of the hash.

    Only the low 88 bits matter, so digits are folded into two limbs of 44 bits. A character outside the alphabet is an error, as are
    fewer than eleven decoded bytes.
    """
    chars = F.split(address, "")
    digits = F.transform(chars, lambda c: F.instr(F.lit(BASE58_ALPHABET), c).cast("long") - 1)
    zero = F.lit(0).cast("long")
    start = F.struct(zero.alias("lo"), zero.alias("hi"), zero.alias("over"))

    def step(a: Column, d: Column) -> Column:
        lo = a["lo"] * 58 + d
        hi = a["hi"] * 58 + F.shiftright(lo, 44)
        return F.struct(lo.bitwiseAND(F.lit(LIMB)).alias("lo"), hi.bitwiseAND(F.lit(LIMB)).alias("hi"), a["over"].bitwiseOR(F.shiftright(hi, 44)).alias("over"))

    def finish(a: Column) -> Column:
        lo, hi = a["lo"], a["hi"]
        byte = lambda x, s: F.shiftright(x, s).bitwiseAND(F.lit(255))
        nibble = lambda x, s: F.shiftright(x, s).bitwiseAND(F.lit(15))
        parts = [(nibble(lo, 16), 60), (byte(lo, 24), 52), (byte(lo, 32), 44), (nibble(lo, 40).bitwiseOR(F.shiftleft(nibble(hi, 0), 4)), 36), (byte(hi, 4), 28), (byte(hi, 12), 20), (byte(hi, 20), 12), (byte(hi, 28), 4), (nibble(hi, 40), 0)]
        value = zero
        for x, s in parts:
            value = value.bitwiseOR(F.shiftleft(x, s))
        bits = F.when(hi > 0, 44 + F.length(F.bin(hi))).when(lo > 0, F.length(F.bin(lo))).otherwise(0)
        size = F.when(a["over"] > 0, 12).otherwise(F.ceil(bits / 8)) + F.length(F.regexp_extract(address, r"\A(1*)", 1))
        return fail_if(size < 11, "a short id takes eleven bytes", value)

    folded = F.aggregate(digits, start, step, finish)
    return fail_if(~address.rlike(rf"\A[{BASE58_ALPHABET}]*\z"), "not a Base58 text", folded)
