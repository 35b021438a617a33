"""A stream of ledger rows into a root: each micro-batch is one commit, and a replayed one does nothing."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.ingest import block_changes
from ..root import LedgerRoot
from ..sources.files import Files


def ingest_stream(rows: DataFrame, root: LedgerRoot, name: str, checkpoint: str, order: str = "seq", available_now: bool = True) -> StreamingQuery:
    """Writes a stream with the columns of a ledger batch. The batch number is committed with its rows and blocks, under the stream's name."""

    def write(batch: DataFrame, number: int) -> None:
        root.add_transactions(batch, order, token=(name, number))

    writer = rows.writeStream.queryName(name).option("checkpointLocation", checkpoint).foreachBatch(write)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def log_stream(rows: DataFrame, folder: str, checkpoint: str, order: str = "seq", available_now: bool = True) -> StreamingQuery:
    """Writes order, block of rows whose block isn't that of the row before, over the whole stream, to a folder of Parquet for each micro-batch.

    A micro-batch is dealt out by ranges of the order, so no task sees all of it. The last block is kept beside the folders with the number of its batch
    and the block before, so that a batch that is run again writes its folder over, with the same rows.
    """
    files = Files(rows.sparkSession, folder)
    files.make_folder()

    def write(batch: DataFrame, number: int) -> None:
        held = json.loads(files.read("_last.json")) if files.exists("_last.json") else {"batch": -1, "before": None, "last": None}
        before = held["before"] if held["batch"] == number else held["last"]
        blocks = batch.select(F.col(order).cast("long").alias(order), F.col("block").cast("long").alias("block"))
        staged = f"staged-{uuid.uuid4().hex}"
        try:
            changes = block_changes(blocks, order, before, f"{files.root}/{staged}")
            changes.write.mode("overwrite").parquet(f"{files.root}/batch={number}")
            last = files.spark.read.parquet(f"{files.root}/{staged}").agg(F.max_by("block", order)).first()[0]
        finally:
            files.delete(staged)
        files.write("_last.json", json.dumps({"batch": number, "before": before, "last": before if last is None else last}))

    writer = rows.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def block_changes_stream(rows: DataFrame, key: str, order: str = "seq") -> DataFrame:
    """key, order, block of rows whose block isn't that of the row before with the same key (say, a chain), as a stream.

    The last block of a key is state. A micro-batch's rows of one key are put in order by one task: a stream that is one sequence is for
    log_stream(). A block that comes again later is logged again.
    """

    def changes(group: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(parts)).sort_values("o")
        last = state.get[0] if state.exists else None
        before = rows["block"].shift()
        changed = rows["block"] != before
        if last is not None and len(rows):
            changed.iloc[0] = rows["block"].iloc[0] != last
        if len(rows):
            state.update((int(rows["block"].iloc[-1]),))
        yield pd.DataFrame({"key": group[0], "seq": rows["o"][changed], "block": rows["block"][changed]})

    keyed = rows.select(F.col(key).cast("string").alias("key"), F.col(order).cast("long").alias("o"), F.col("block").cast("long").alias("block"))
    return keyed.groupBy("key").applyInPandasWithState(changes, "key string, seq long, block long", "last long", "append", GroupStateTimeout.NoTimeout)
