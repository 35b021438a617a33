"""What the operators share: durable intermediate tables, batch sizes, row identity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import fresh_path, materialize

__all__ = ["ascii_lower", "bounded_batches", "fresh_path", "materialize", "packed", "small", "unpacked"]

#: Bytes of one Arrow batch between the JVM and a Python worker.
BATCH_BYTES = 16 << 20
#: Bytes of a table, by its rows and the lengths of its texts, up to which it is sent to every executor.
BROADCAST_BYTES, ROW_BYTES = 32 << 20, 64


def bounded_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches by bytes, so that long texts don't make batches of gigabytes."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4000")


def small(df: DataFrame) -> DataFrame:
    """df, a table, with a broadcast hint if its measured size is under the bound; else df, for a shuffle join. One pass over it measures."""
    texts = [F.octet_length(f"`{n}`") for n, kind in df.dtypes if kind in ("string", "binary")]
    texts += [F.aggregate(F.transform(f"`{n}`", F.octet_length), F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) for n, kind in df.dtypes if kind == "array<string>"]
    size = df.agg(F.sum(sum((F.coalesce(t, F.lit(0)) for t in texts), F.lit(ROW_BYTES)).cast("long"))).first()[0] or 0
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else; lower() does just that where all characters are ASCII."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


def packed(df: DataFrame, **columns: Column) -> DataFrame:
    """The rows of df as one struct, _in, beside the given columns, so that no name of df's can clash with another."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_in"), *[c.alias(name) for name, c in columns.items()])


def unpacked(columns: list[str]) -> list[Column]:
    """Columns of the packed rows, under their names."""
    return [F.col("_in").getField(c).alias(c) for c in columns]
