"""A ledger: transactions, addresses and the log of block changes under one folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .model import ADDRESSES, BLOCK_LOG, LEDGER_BATCH, TRANSACTIONS, signed
from .operators import ingest, lookup
from .operators.numbering import number_rows
from .plans.compaction import Progress
from .sources.files import Files
from .sources.options import StoreOptions, write_or_verify
from .store import LedgerStore

#: Name of the block log's state in the commits of the transactions.
BLOCK_LOG_STATE = "block_log"


class BlockChangeLog:
    """Changes of the block number, in the order of arrival, with the time each was first seen: folders of Parquet, and a state that
    says which count. The state is committed with the transactions, so that no row is without its block, nor a block without its row."""

    def __init__(self, spark: SparkSession, files: Files, state: dict | None = None):
        self.spark, self.files = spark, files
        self.state = state or {"seq": 0, "last": None, "parts": []}

    @property
    def last(self) -> int | None:
        return self.state["last"]

    @property
    def table(self) -> DataFrame:
        paths = [f"{self.files.root}/{p}" for p in self.state["parts"]]
        return self.spark.read.schema(BLOCK_LOG).parquet(*paths) if paths else self.spark.createDataFrame([], BLOCK_LOG)

    def log(self, rows: DataFrame, order: str = "seq", at: datetime | None = None) -> None:
        """Logs each row's block that isn't the one logged before it; all rows of a batch are stamped alike, to the millisecond.

        What a lost commit had written is written over.
        """
        now = at or datetime.now(UTC)
        now = now.replace(microsecond=now.microsecond // 1000 * 1000)
        path = f"blocklog/{self.state['seq']:012d}-{len(self.state['parts'])}"
        staged = f"blocklog-staged/{uuid.uuid4().hex}"
        try:
            changes = ingest.block_changes(rows, order, self.last, f"{self.files.root}/{staged}/rows")
            numbered, n = number_rows(changes, order, f"{self.files.root}/{staged}/changes", self.state["seq"])
            if n:
                numbered.select(F.col("ordinal").alias("seq"), "block", F.lit(now).cast("timestamp").alias("first_seen_ts")).write.mode("overwrite").parquet(f"{self.files.root}/{path}")
                last = self.spark.read.parquet(f"{self.files.root}/{path}").agg(F.max_by("block", "seq")).first()[0]
                self.state = {"seq": self.state["seq"] + n, "last": last, "parts": [*self.state["parts"], path]}
        finally:
            self.files.delete(staged)

    def lines(self) -> DataFrame:
        """value: the log as lines of text, "block stamp", by seq."""
        stamp = F.date_format("first_seen_ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
        return self.table.orderBy("seq").select(F.concat_ws(" ", "block", stamp).alias("value"))


class LedgerRoot:
    def __init__(self, spark: SparkSession, path: str, options: StoreOptions | None = None):
        if not path or not path.strip():
            raise ValueError("a root takes a path")
        self.spark, self.path, self.options = spark, path, (options or StoreOptions()).validate()
        self.files = Files(spark, path)
        self.files.make_folder()
        write_or_verify(self.files, self.options)
        self.transactions = LedgerStore(spark, path, TRANSACTIONS, self.options)
        self.block_log = BlockChangeLog(spark, self.files, self.transactions.manifest.attached.get(BLOCK_LOG_STATE))
        self.addresses = LedgerStore(spark, path, ADDRESSES, self.options)
        self.closed = False

    def __enter__(self) -> LedgerRoot:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    def close(self) -> None:
        if not self.closed:
            self.flush()
            self.closed = True

    def flush(self, token: tuple[str, int] | None = None) -> None:
        """Addresses first, which a replay finds and doesn't add again; then, in one step, transactions, the block log and the stream's batch."""
        self.addresses.flush()
        self.transactions.flush(token, {BLOCK_LOG_STATE: self.block_log.state})

    # writes

    def _together(self, write: Callable[[], int], token: tuple[str, int] | None = None) -> int:
        """Rows and their blocks are in the same commit, made at the end if there is a token or a store is full. After an error neither is pending."""
        held = list(self.transactions.pending), self.block_log.state
        try:
            first = write()
            if token or self.transactions.full or self.addresses.full:
                self.flush(token)
            return first
        except BaseException:
            self.transactions.pending, self.block_log.state = held
            raise

    def add_transactions(self, batch: DataFrame, order: str = "seq", token: tuple[str, int] | None = None) -> int:
        """A ledger batch, as LEDGER_BATCH, in the order of a column: absent addresses are stored, ids resolved, transactions appended, blocks logged.

        token: a stream's name and batch, committed with the rows; a batch that is in already, by its number, changes nothing.
        """
        if token and self.transactions.manifest.tokens.get(token[0], -1) >= token[1]:
            return self.transactions.count
        rows = batch.select(F.col(order).alias("seq"), *[F.col(f"`{c}`") for c in LEDGER_BATCH])

        def write() -> int:
            new = ingest.addresses_to_insert(rows, self.addresses.table)
            self.addresses.append_range(new.select((F.col("seq") * 4 + F.col("pos")).alias("seq"), "id", "address"), commit=False)
            first = self.transactions.append_range(ingest.resolve_transactions(rows, self.addresses.table), commit=False)
            self.block_log.log(rows.select("seq", F.col("block").cast("long").alias("block")))
            return first

        return self._together(write, token)

    def add_packed_transactions(self, batch: DataFrame, order: str = "seq") -> int:
        """Rows of seq, v0..v3, block and amount, appended as they are, with their blocks logged."""
        rows = ingest.packed_transactions(batch.withColumn("seq", F.col(order)))

        def write() -> int:
            first = self.transactions.append_range(rows, commit=False)
            self.block_log.log(rows.select("seq", "block"))
            return first

        return self._together(write)

    def add_transaction(self, *values: object) -> int:
        """One transaction: the ten values of LEDGER_BATCH, or v0, v1, v2, v3, block, amount."""
        if len(values) == 6:
            row = [signed(v) for v in values[:4]] + list(values[4:])
            return self.add_packed_transactions(self.spark.createDataFrame([(0, *row)], "seq long, v0 long, v1 long, v2 long, v3 long, block long, amount long"))
        types = ["string" if c in ("from", "to", "prev_tx", "tx") else "long" for c in LEDGER_BATCH]
        row = [signed(v) if isinstance(v, int) else v for v in values]
        return self.add_transactions(self.spark.createDataFrame([(0, *row)], "seq long, " + ", ".join(f"`{c}` {t}" for c, t in zip(LEDGER_BATCH, types, strict=True))))

    def add_address(self, short_id: int, text: str) -> int:
        """An address of exactly 65 ASCII characters; others are an error, as they aren't padded here."""
        return self.addresses.append(short_id, text)

    # reads

    def transactions_by(self, value: int, key: int, by_index: bool = False) -> DataFrame:
        """By value number 0 to 3."""
        if not 0 <= value <= 3:
            raise IndexError(f"value {value} has no index")
        return self.transactions.find(f"v{value}", key, by_index)

    def transactions_in_block(self, block: int) -> DataFrame:
        """Looks the block up in v2, where six-value appends of callers may keep it; see transactions_in_packed_block()."""
        return self.transactions_by(2, block)

    def transactions_by_amount(self, amount: int) -> DataFrame:
        """Looks the amount up in v3; see transactions_by_packed_amount()."""
        return self.transactions_by(3, amount)

    def transactions_in_packed_block(self, block: int) -> DataFrame:
        return lookup.transactions_in_packed_block(self.transactions.table, block)

    def transactions_by_packed_amount(self, amount: int) -> DataFrame:
        return lookup.transactions_by_packed_amount(self.transactions.table, amount)

    def addresses_of(self, short_id: int) -> DataFrame:
        """address of every row with the id."""
        return self.addresses.find("id", short_id).select("address")

    def first_address(self, short_id: int) -> str | None:
        row = lookup.first_match(self.addresses.find("id", short_id)).first()
        return row and row.address

    def find_address(self, text: str) -> DataFrame:
        return lookup.find_address(self.addresses.table, text)

    def ids_of(self, text: str) -> DataFrame:
        """id of every row with the text; texts under 55 characters are filled to 55, and only 65 can be found."""
        return self.find_address(text if len(text) >= 55 else text.ljust(55, "A")).select("id")

    def first_id(self, text: str) -> int | None:
        row = lookup.first_match(self.find_address(text)).first()
        return None if row is None else row.id

    @property
    def last_logged_block(self) -> int | None:
        return self.block_log.last

    # maintenance

    def planned_maintenance_entries(self) -> int:
        return self.transactions.planned_maintenance_entries() + self.addresses.planned_maintenance_entries()

    def maintain(self, callback: Callable[[Progress], None] | None = None) -> int:
        """Merges the runs of all indexes; the callback sees one course of progress over both stores."""
        self.flush()
        total = self.planned_maintenance_entries()
        done = self.transactions.maintain(callback, 0, total)
        return self.addresses.maintain(callback, done, total)

    def statistics(self) -> DataFrame:
        return self.transactions.index_statistics().withColumn("store", F.lit("transactions")).unionByName(self.addresses.index_statistics().withColumn("store", F.lit("addresses")))

