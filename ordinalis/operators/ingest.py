"""Write-side operators over whole batches: insert addresses that are absent, resolve canonical ids, pack payloads.

Each gives what a row-at-a-time loop in seq order would give.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import codecs
from .numbering import deal_out


def batch_addresses(batch: DataFrame) -> DataFrame:
    """seq, pos, id, address of the four texts of each row, in the order a row writes them, padded."""
    four = F.array(
        F.struct(F.col("from_short").alias("id"), codecs.padded_address(F.col("from")).alias("address")),
        F.struct(F.col("to_short").alias("id"), codecs.padded_address(F.col("to")).alias("address")),
        F.struct(F.col("prev_short").alias("id"), codecs.padded_tx(F.col("prev_tx")).alias("address")),
        F.struct(F.col("tx_short").alias("id"), codecs.padded_tx(F.col("tx")).alias("address")),
    )
    return batch.select("seq", F.posexplode(four).alias("pos", "a")).select("seq", "pos", "a.id", "a.address")


def addresses_to_insert(batch: DataFrame, stored: DataFrame) -> DataFrame:
    """seq, pos, id, address of each text that isn't stored, from the first place that has it.

    The first place is a minimum, found with partial sums before the shuffle, so a text in a third of all rows costs a row per task.
    """
    first = batch_addresses(batch).groupBy("address").agg(F.min(F.struct("seq", "pos", "id")).alias("f")).select("f.seq", "f.pos", "f.id", "address")
    return first.join(stored.select("address"), "address", "left_anti")


def canonical_ids(addresses: DataFrame) -> DataFrame:
    """address, id: the id of the least ordinal."""
    return addresses.groupBy("address").agg(F.min_by("id", "ordinal").alias("id"))


def resolve_transactions(batch: DataFrame, addresses: DataFrame) -> DataFrame:
    """seq, v0..v4, block: senders and recipients by their canonical id, transactions by the caller's short ids, block and amount packed.

    addresses must hold those of the batch already. The canonical side is cut down to the batch's texts first, and is left to adaptive
    execution, which splits a hot sender's rows.
    """
    texts = batch.select(F.explode(F.array(codecs.padded_address(F.col("from")), codecs.padded_address(F.col("to")))).alias("address")).distinct()
    known = canonical_ids(addresses.join(texts, "address", "left_semi"))
    rows = batch.withColumns({"_from": codecs.padded_address(F.col("from")), "_to": codecs.padded_address(F.col("to"))})
    sender, recipient = known.select(F.col("address").alias("_from"), F.col("id").alias("v0")), known.select(F.col("address").alias("_to"), F.col("id").alias("v1"))
    return rows.join(sender, "_from").join(recipient, "_to").select("seq", "v0", "v1", F.col("prev_short").alias("v2"), F.col("tx_short").alias("v3"), codecs.pack(F.col("block"), F.col("amount")).alias("v4"), F.col("block").cast("long").alias("block"))


def packed_transactions(batch: DataFrame) -> DataFrame:
    """seq, v0..v4, block from seq, v0..v3, block, amount."""
    return batch.select("seq", "v0", "v1", "v2", "v3", codecs.pack(F.col("block"), F.col("amount")).alias("v4"), F.col("block").cast("long").alias("block"))


def block_changes(rows: DataFrame, order: str = "seq", last: int | None = None, staged: str | None = None) -> DataFrame:
    """order, block of rows whose block isn't that of the row before; last: the block logged before the first row, or None.

    Rows are dealt by ranges of the order and compared inside each; only the last block of each range, a row per range, goes to
    the next one. So no task sees all rows, though the comparison is over all. staged: see deal_out().
    """
    dealt = deal_out(rows.select(order, "block"), order, staged)
    ends = dealt.groupBy("_part").agg(F.max_by("block", "_place").alias("_end"))
    carried = ends.select("_part", F.coalesce(F.lag("_end").over(Window.orderBy("_part")), F.lit(last).cast("long")).alias("_carried"))
    inside = F.lag("block").over(Window.partitionBy("_part").orderBy("_place"))
    compared = dealt.withColumn("_inside", inside).join(F.broadcast(carried), "_part")
    before = F.when(F.col("_place") == 0, F.col("_carried")).otherwise(F.col("_inside"))
    return compared.where(~F.col("block").eqNullSafe(before)).select(order, "block")
