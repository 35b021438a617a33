"""Reads of tables with an ordinal: equality lookups, positional reads, counts. Plans are left to Catalyst; filters reach the Parquet scan."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import codecs
from ..model import signed

#: Keys that a batch of probes may have, by count, to be sent to every task.
BROADCAST_KEYS = 1_000_000


def find(table: DataFrame, key: Column | str, value: int) -> DataFrame:
    """All rows whose key has the value, by ordinal; none if there is none. value: an unsigned 64-bit value or its long."""
    return table.where((F.col(key) if isinstance(key, str) else key) == F.lit(signed(value))).orderBy("ordinal")


def find_ordinals(table: DataFrame, key: Column | str, value: int) -> DataFrame:
    """The same rows' ordinals; the scan reads the key and the ordinal alone."""
    return find(table, key, value).select("ordinal")


def count_by(table: DataFrame, key: Column | str, value: int) -> DataFrame:
    """One row, n: how many rows have the value."""
    return table.where((F.col(key) if isinstance(key, str) else key) == F.lit(signed(value))).agg(F.count("*").alias("n"))


def rows_at(table: DataFrame, hits: DataFrame) -> DataFrame:
    """Rows of the ordinals in hits, by ordinal. Their span, from their count, least and greatest, goes into the table's scan."""
    span = hits.agg(F.count("*").alias("n"), F.min("ordinal").alias("a"), F.max("ordinal").alias("b")).first()
    if not span.n:
        return table.limit(0)
    near = table.where(F.col("ordinal").between(span.a, span.b))
    return near.join(F.broadcast(hits) if span.n <= BROADCAST_KEYS else hits, "ordinal", "left_semi").orderBy("ordinal")


def find_address(addresses: DataFrame, text: str) -> DataFrame:
    """Rows with just this address: candidates by the eight-character prefix, confirmed by the whole text."""
    if len(text) != codecs.ADDRESS_LENGTH or not text.isascii():
        raise ValueError(f"an address has {codecs.ADDRESS_LENGTH} ASCII characters")
    return addresses.where((F.col("address") == text) & F.col("address").startswith(text[: codecs.PREFIX_LENGTH])).orderBy("ordinal")


def prefix_candidates(addresses: DataFrame, text: str) -> DataFrame:
    """What the prefix alone finds."""
    return addresses.where(F.col("address").startswith(text[: codecs.PREFIX_LENGTH])).orderBy("ordinal")


def transactions_in_packed_block(transactions: DataFrame, block: int) -> DataFrame:
    """By the block in the payload: a range of payloads, so that files sorted by block are skipped."""
    low, high = block << codecs.BLOCK_SHIFT, (block << codecs.BLOCK_SHIFT) + codecs.AMOUNT_MASK
    if block < 1 << 20:
        return transactions.where(F.col("v4").between(low, high)).orderBy("ordinal")
    return transactions.where(codecs.block_of(F.col("v4")) == block).orderBy("ordinal")


def transactions_by_packed_amount(transactions: DataFrame, amount: int) -> DataFrame:
    return transactions.where(codecs.amount_of(F.col("v4")) == amount).orderBy("ordinal")


def first_match(rows: DataFrame) -> DataFrame:
    return rows.orderBy("ordinal").limit(1)


def last_match(rows: DataFrame) -> DataFrame:
    return rows.orderBy(F.col("ordinal").desc()).limit(1)


def read_ordinal(table: DataFrame, ordinal: int, count: int) -> DataFrame:
    if not 0 <= ordinal < count:
        raise IndexError(f"ordinal {ordinal} is outside 0..{count - 1}")
    return table.where(F.col("ordinal") == ordinal)


def read_range(table: DataFrame, start: int, n: int, count: int) -> DataFrame:
    """n rows from start; reading past the end is an error, reading none isn't."""
    if n and not 0 <= start <= start + n <= count:
        raise IndexError(f"rows {start}..{start + n - 1} are outside 0..{count - 1}")
    return table.where(F.col("ordinal").between(start, start + n - 1)).orderBy("ordinal")


def field(table: DataFrame, position: int) -> Column:
    """A transaction's value by position, 0 to 4."""
    if not 0 <= position <= 4:
        raise IndexError(f"a transaction has no value {position}")
    return table[f"v{position}"]


def probe_counts(probes: DataFrame, table: DataFrame, key: str, n_probes: int) -> DataFrame:
    """probe, n for every distinct probe, 0 if none: one join for all.

    The table is counted by key before any shuffle. n_probes, the counted number of probes, decides whether they go to every task.
    """
    asked = probes.select(F.col("probe")).distinct()
    few = F.broadcast(asked) if n_probes <= BROADCAST_KEYS else asked
    found = table.join(few, table[key] == few["probe"], "left_semi").groupBy(F.col(key).alias("k")).agg(F.count("*").alias("n"))
    return asked.join(found, F.col("probe") == F.col("k"), "left").select("probe", F.coalesce("n", F.lit(0)).alias("n"))


def union_runs(runs: list[DataFrame]) -> DataFrame:
    """All postings of several runs, by key and ordinal."""
    return reduce(DataFrame.unionByName, runs).orderBy("key", "ordinal")


def key_statistics(table: DataFrame, keys: Mapping[str, Column]) -> DataFrame:
    """index, n, min_key, max_key of each index's keys, in one pass."""
    found = table.agg(F.count("*").alias("n"), *[f(k).alias(f"{name}_{i}") for name, k in keys.items() for i, f in enumerate((F.min, F.max))])
    return found.select(F.inline(F.array(*[F.struct(F.lit(name).alias("index"), F.col("n"), F.col(f"{name}_0").alias("min_key"), F.col(f"{name}_1").alias("max_key")) for name in keys])))
