"""Schemas and limits of the two ledger tables, and the description of a store that users can make their own."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions import codecs

#: An amount takes the low 43 bits of a payload, a block the bits above.
BLOCK_SHIFT = codecs.BLOCK_SHIFT
MAX_BLOCK, MAX_AMOUNT = codecs.MAX_BLOCK, codecs.MAX_AMOUNT
ADDRESS_LENGTH = codecs.ADDRESS_LENGTH


def required(**types: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v, False) for k, v in types.items()])


#: Unsigned 64-bit values are kept as the long of the same bits: equality and bit operations don't see the sign.
TRANSACTION = required(v0=T.LongType(), v1=T.LongType(), v2=T.LongType(), v3=T.LongType(), v4=T.LongType())
ADDRESS = required(id=T.LongType(), address=T.StringType())
BLOCK_LOG = required(seq=T.LongType(), block=T.LongType(), first_seen_ts=T.TimestampType())
POSTING = required(key=T.LongType(), ordinal=T.LongType())
#: What a ledger batch has: short ids, texts, amount and block of each transaction.
LEDGER_BATCH = ("from_short", "from", "to_short", "to", "prev_short", "prev_tx", "tx_short", "tx", "amount", "block")


@dataclass(frozen=True)
class StoreSpec:
    """A table by ordinal: its fields, the key expression of each index, a test that every row must pass, and bytes per row for reports."""

    name: str
    fields: T.StructType
    indexes: dict[str, Callable[[], Column]]
    valid: Callable[[], Column] | None = None
    row_bytes: int = 0


TRANSACTIONS = StoreSpec("transactions", TRANSACTION, {f"v{i}": (lambda i=i: F.col(f"v{i}")) for i in range(4)}, row_bytes=40)
ADDRESSES = StoreSpec("addresses", ADDRESS, {"id": lambda: F.col("id"), "address": lambda: codecs.address_prefix(F.col("address"))}, valid=lambda: codecs.address_is_valid(F.col("address")), row_bytes=73)


def signed(x: int) -> int:
    """The long with the bits of an unsigned 64-bit value; longs stay."""
    if not -(1 << 63) <= x < 1 << 64:
        raise ValueError(f"{x} doesn't fit 64 bits")
    return x - (1 << 64) if x >> 63 == 1 else x
