"""The block log as text: a line for each change, "block stamp", the stamp in UTC to the millisecond."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LINE = r"\A([0-9]+) ([0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}\.[0-9]{3}Z)\z"
#: The last line lies in the last bytes of the file.
TAIL_BYTES = 128


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """block, first_seen_ts of every line that can be parsed."""
    parsed = spark.read.text(path).select(F.regexp_extract("value", LINE, 1).alias("b"), F.regexp_extract("value", LINE, 2).alias("t")).where("b != ''")
    return parsed.select(F.col("b").cast("long").alias("block"), F.to_timestamp("t", "yyyy-MM-dd'T'HH:mm:ss.SSSX").alias("first_seen_ts"))


def last_block(tail: bytes) -> int | None:
    """The block of a log's final line, from the file's last bytes; None if there is no line or it can't be parsed."""
    lines = tail[-TAIL_BYTES:].decode("ascii", "replace").rstrip("\n").split("\n")
    first = lines[-1].split(" ")[0]
    return int(first) if first.isascii() and first.isdigit() else None
