"""Synthetic ledger tables from a counter-based generator: any row without those before it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.generators import splitmix64, synthetic_address


def _modulo(x: Column, n: int) -> Column:
    """The remainder of the unsigned value of a long."""
    half = F.shiftrightunsigned(x, 1)
    return (half % n * 2 + x.bitwiseAND(F.lit(1))) % n


def transactions(spark: SparkSession, count: int, keys: int | None = None, stored: int = 0) -> DataFrame:
    """seq, v0..v4: five draws a row of one generator seeded with stored + 1; v0, v1 and v2 are modulo keys, by default an eighth of count."""
    keys = max(count // 8, 1) if keys is None else keys
    draw = lambda k: splitmix64(F.lit(stored + 1).cast("long"), F.col("id") * 5 + k)
    rows = spark.range(count).select(F.col("id").alias("seq"), *[draw(k).alias(f"v{k}") for k in range(5)])
    return rows.select("seq", *[_modulo(F.col(f"v{k}"), keys).alias(f"v{k}") for k in range(3)], "v3", "v4")


def addresses(spark: SparkSession, count: int, stored: int = 0) -> DataFrame:
    """seq, id, address: ids go on from the rows stored so far; the id is the address's seed."""
    return spark.range(count).select(F.col("id").alias("seq"), (F.col("id") + stored).alias("id"), synthetic_address(F.col("id") + stored).alias("address"))
