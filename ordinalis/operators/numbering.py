"""Dense numbers in the order of columns, for rows in any number of tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import fresh_path

#: Row index bits of monotonically_increasing_id(); the bits above are the task.
ROW_BITS = 33


def deal_out(rows: DataFrame, order: str | list[str], staged: str | None = None) -> DataFrame:
    """rows with _part and _place: the range of the order that a row fell into, and its place there.

    Written to the folder staged, or one of its own, and read back: ranges come from samples, so only a written table has them alike
    each time it is read.
    """
    spark, order = rows.sparkSession, [order] if isinstance(order, str) else order
    staged = staged or fresh_path(spark, "dealt")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()).write.parquet(staged)
    back = spark.read.parquet(staged)
    return back.withColumns({"_part": F.shiftright("_id", ROW_BITS), "_place": F.col("_id").bitwiseAND(F.lit((1 << ROW_BITS) - 1))}).drop("_id")


def number_rows(rows: DataFrame, order: str | list[str], staged: str | None = None, first: int = 0, name: str = "ordinal") -> tuple[DataFrame, int]:
    """rows with a number, `name`, from first on, and how many there are. Only the parts' row counts, one number each, are added up.

    The result reads the folder staged, which the caller deletes.
    """
    dealt = deal_out(rows, order, staged)
    sizes = dealt.groupBy("_part").agg(F.count("*").alias("n"))
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    before = F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_start"))
    number = F.lit(first).cast("long") + F.col("_start") + F.col("_place")
    return dealt.join(F.broadcast(starts), "_part").withColumn(name, number).drop("_part", "_place", "_start"), total
