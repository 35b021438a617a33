"""Queries that go through the real stores: append, commit, reopen, look up by index run, compact, rebuild, replay, stream, export.

Roots lie in the scratch folder. One of orders and customers is made once for a session, a folder and the files in it, as a user's would
be there already; queries open it anew. Queries about writing make roots of their own.
"""

from __future__ import annotations

from collections.abc import Callable
from contextlib import suppress

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.codecs import BASE58_ALPHABET
from .functions.generators import ADDRESS_ALPHABET, ADDRESS_SEED, GAMMA, MIX_1, MIX_2, base58_decode, splitmix64
from .model import ADDRESS_LENGTH, TRANSACTIONS, StoreSpec, required
from .operators import lookup
from .plans.compaction import Progress
from .queries import ADDR, BATCH, KEY, LOG, TEXT, TX, addresses, blocks, files_of, ledger_batch, stored_texts, table, transactions
from .root import LedgerRoot
from .sources import block_text, fixed_width
from .sources.options import StoreOptions
from .sources.scratch import fresh_path
from .store import LedgerStore
from .streaming.ingest import ingest_stream, log_stream

OPTIONS = StoreOptions(merge_fanout=3)
SUPPLIERS = StoreSpec("suppliers", required(s_suppkey=TRANSACTIONS.fields["v0"].dataType, s_nationkey=TRANSACTIONS.fields["v0"].dataType), {"nation": lambda: F.col("s_nationkey")}, row_bytes=16)
SEGMENT = 1 << 16

_roots: dict[tuple, str] = {}


def thirds(rows: DataFrame, key: str) -> list[DataFrame]:
    """rows in three parts by ranges of the key."""
    low, high = rows.agg(F.min(key), F.max(key)).first()
    a, b = low + (high - low) // 3, low + 2 * (high - low) // 3
    return [rows.where(F.col(key) <= a), rows.where((F.col(key) > a) & (F.col(key) <= b)), rows.where(F.col(key) > b)]


def fill(spark: SparkSession, folder: str, root: LedgerRoot) -> None:
    """Orders in three commits, customers in one."""
    for part in thirds(transactions(spark, folder), "v3"):
        root.transactions.append_range(part.withColumn("seq", F.col("v3")))
        root.flush()
    root.addresses.append_range(addresses(spark, folder).withColumn("seq", F.col("id")))


def kept_root(spark: SparkSession, folder: str, name: str, tables: list[str], make: Callable[[str], None], options: StoreOptions | None = None) -> LedgerRoot:
    """A root that is made once for a session, a folder and its files, opened."""
    key = (spark.sparkContext.applicationId, name, *(x for t in tables for x in files_of(spark, folder, t)))
    if key not in _roots:
        path = fresh_path(spark, name)
        make(path)
        _roots[key] = path
    return LedgerRoot(spark, _roots[key], options)


def filled(spark: SparkSession, folder: str) -> LedgerRoot:
    """The root of orders and customers."""

    def make(path: str) -> None:
        with LedgerRoot(spark, path, OPTIONS) as root:
            fill(spark, folder, root)

    return kept_root(spark, folder, "ledger", ["orders", "customer"], make, OPTIONS)


def own_store(spark: SparkSession, folder: str) -> LedgerStore:
    """A store of orders in three commits."""
    store = LedgerStore(spark, fresh_path(spark, "store"), TRANSACTIONS, OPTIONS)
    for part in thirds(transactions(spark, folder), "v3"):
        store.append_range(part.withColumn("seq", F.col("v3")))
        store.flush()
    return store


def reopened(store: LedgerStore) -> LedgerStore:
    return LedgerStore(store.spark, store.files.root, store.spec, store.options)


def compacted(spark: SparkSession, folder: str) -> DataFrame:
    store = own_store(spark, folder)
    store.maintain()
    return reopened(store).postings("v0")


def maintenance(spark: SparkSession, folder: str) -> DataFrame:
    """planned, done, last_done, last_percentage, stages, misplaced, vacuumed, segments of a store before and after its merges."""
    store, seen = own_store(spark, folder), list[Progress]()
    planned, before = store.planned_maintenance_entries(), sum(map(len, store.manifest.indexes.values()))
    done = store.maintain(seen.append)
    store = reopened(store)
    row = (planned, done, seen[-1].done, seen[-1].percentage, len({p.stage for p in seen}), sum(store.misplaced(i) for i in store.spec.indexes), len(store.vacuum()), before, sum(map(len, store.manifest.indexes.values())), store.planned_maintenance_entries())
    return spark.createDataFrame([row], "planned long, done long, last_done long, last_percentage double, stages long, misplaced long, vacuumed long, before long, after long, left_over long")


def rebuilt(spark: SparkSession, folder: str) -> DataFrame:
    """An index's postings after its folder was lost."""
    store = own_store(spark, folder)
    store.files.delete("transactions/index-v2")
    return reopened(store).postings("v2")


def pending(spark: SparkSession, folder: str) -> DataFrame:
    """state, n, committed, hits: rows that aren't committed are seen by their store, also beside committed ones, and by no other.

    The append doesn't commit, however many rows it has: a full store would by itself.
    """
    store = own_store(spark, folder)
    store.append_range(transactions(spark, folder).where("v3 % 2 = 0").withColumn("seq", F.col("v3")), commit=False)
    rows = [(name, s.count, s.committed_count, s.count_by("v0", KEY)) for name, s in (("pending", store), ("reopened", reopened(store)))]
    return spark.createDataFrame(rows, "state string, n long, committed long, hits long")


def ingested(spark: SparkSession, folder: str) -> LedgerRoot:
    """A root that had stored_texts(), and then the batch in three parts, each twice, as a replay, and each time in a session of its own."""

    def make(path: str) -> None:
        with LedgerRoot(spark, path, OPTIONS) as root:
            root.addresses.append_range(stored_texts(spark, folder).withColumn("seq", F.col("ordinal")))
        for k, part in enumerate(thirds(ledger_batch(spark, folder), "seq")):
            for _ in range(2):
                with LedgerRoot(spark, path, OPTIONS) as root:
                    root.add_transactions(part, token=("orders", k))

    return kept_root(spark, folder, "ingested", ["orders", "customer"], make, OPTIONS)


def replayed(spark: SparkSession, folder: str) -> DataFrame:
    root = ingested(spark, folder)
    n, total = root.transactions.table.agg(F.count("*"), F.sum("v3")).first()
    return spark.createDataFrame([(n, total, root.block_log.table.count())], "n long, total long, changes long")


def crashed(spark: SparkSession, folder: str) -> DataFrame:
    """A batch over the commit threshold whose first run ends before its commit, and its replay: n, changes, logged."""
    path, options = fresh_path(spark, "crashed"), StoreOptions(memtable_entries=1024, max_segment_entries=4096)
    batch = ledger_batch(spark, folder)

    class Crash(RuntimeError):
        pass

    def fail(*_: object, **__: object) -> None:
        raise Crash

    root = LedgerRoot(spark, path, options)
    root.flush = fail
    with suppress(Crash):
        root.add_transactions(batch, token=("s", 0))
    with LedgerRoot(spark, path, options) as root:
        root.add_transactions(batch, token=("s", 0))
    root = LedgerRoot(spark, path, options)
    return spark.createDataFrame([(root.transactions.committed_count, root.block_log.table.count(), root.last_logged_block)], "n long, changes long, logged long")


def event_log(spark: SparkSession, folder: str) -> LedgerRoot:
    """A root with the hours of events as blocks, logged in two sessions."""

    def make(path: str) -> None:
        rows = blocks(spark, folder)
        middle = rows.agg(F.avg("seq").cast("long")).first()[0]
        for part in (rows.where(F.col("seq") <= middle), rows.where(F.col("seq") > middle)):
            with LedgerRoot(spark, path) as root:
                root.block_log.log(part)

    return kept_root(spark, folder, "events", ["events"], make)


def log_text(spark: SparkSession, folder: str) -> str:
    path = fresh_path(spark, "text")
    event_log(spark, folder).block_log.lines().coalesce(1).write.text(path)
    return path


def log_tail(spark: SparkSession, folder: str) -> DataFrame:
    path = log_text(spark, folder)
    (content,) = (r.content for r in spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).collect())
    return spark.createDataFrame([(block_text.last_block(bytes(content)),)], "block long")


def streamed_log(spark: SparkSession, folder: str) -> DataFrame:
    """The block log of events as a stream of files."""
    path, source = fresh_path(spark, "log"), fresh_path(spark, "in")
    rows = blocks(spark, folder)
    for part in thirds(rows, "seq"):
        part.coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(rows.schema).parquet(source)
        log_stream(stream, path, f"{path}-checkpoint").awaitTermination()
    return spark.read.schema("seq long, block long").parquet(f"{path}/batch=*")


def streamed_ledger(spark: SparkSession, folder: str) -> DataFrame:
    path, source = fresh_path(spark, "ledger"), fresh_path(spark, "in")
    batch = ledger_batch(spark, folder)
    with LedgerRoot(spark, path) as root:
        for part in thirds(batch, "seq"):
            part.coalesce(1).write.mode("append").parquet(source)
            stream = spark.readStream.schema(batch.schema).parquet(source)
            ingest_stream(stream, root, "orders", f"{path}-checkpoint").awaitTermination()
    return LedgerRoot(spark, path).transactions.table


def exported(spark: SparkSession, rows: DataFrame, kind: str) -> DataFrame:
    """rows after a way through fixed-width files."""
    path = fresh_path(spark, kind)
    fixed_width.write_records(rows, kind, SEGMENT, f"file://{path}" if path.startswith("/") else path)
    return fixed_width.read_records(spark, path, kind, SEGMENT).select(rows.columns)


def options_written(spark: SparkSession, folder: str) -> DataFrame:
    """name, value of the options that a root was made with, read after it was opened with the same again; numbers only."""
    import json

    root = filled(spark, folder)
    written = json.loads(root.files.read("options.json"))
    return spark.createDataFrame([(k, int(v)) for k, v in written.items() if not isinstance(v, bool)], "name string, value long")


def suppliers(spark: SparkSession, folder: str) -> DataFrame:
    """A store of the user's own schema and index."""
    path = fresh_path(spark, "suppliers")
    with LedgerStore(spark, path, SUPPLIERS) as store:
        store.append_range(table(spark, folder, "supplier").select("s_suppkey", F.col("s_nationkey").cast("long").alias("s_nationkey")), "s_suppkey")
    return LedgerStore(spark, path, SUPPLIERS).find("nation", KEY, by_index=True)


def padded_text() -> str:
    return TEXT.ljust(ADDRESS_LENGTH, "A")


def base58_text() -> Column:
    """Names of customers with characters of the alphabet alone."""
    return F.translate("c_name", "#0", "zA")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    for name, value in {"v0": KEY, "v1": 107, "v2": 1000, "v3": 1000}.items():
        q[f"store_find_by_{name}"] = lambda s, d, n=name, v=value: filled(s, d).transactions_by(int(n[1]), v, by_index=True)
        q[f"store_postings_{name}"] = lambda s, d, n=name: filled(s, d).transactions.postings(n)
    one = lambda s, **x: s.createDataFrame([tuple(x.values())], ", ".join(f"{k} long" for k in x))
    q |= {
        "store_scan": lambda s, d: filled(s, d).transactions.table,
        "store_find_missing": lambda s, d: filled(s, d).transactions_by(0, 2**64 - 1, by_index=True),
        "store_find_ordinals": lambda s, d: filled(s, d).transactions.find_ordinals("v0", KEY),
        "store_counts": lambda s, d: (lambda r: one(s, n=r.transactions.count, committed=r.transactions.committed_count, covered=r.transactions.manifest.covered("v3"), hits=r.transactions.count_by("v0", KEY), misses=r.transactions.count_by("v0", 2**64 - 1), addresses=r.addresses.count))(filled(s, d)),
        "store_read": lambda s, d: filled(s, d).transactions.read(100),
        "store_read_range": lambda s, d: filled(s, d).transactions.read_range(200, 50),
        "store_statistics": lambda s, d: filled(s, d).statistics().withColumn("segment_count", F.col("segment_count").cast("long")).withColumn("pending_count", F.col("pending_count").cast("long")),
        "store_compacted_postings": compacted,
        "store_maintenance": maintenance,
        "store_rebuilt_postings": rebuilt,
        "store_pending": pending,
        "store_own_schema": suppliers,
        "store_options": options_written,
        "store_addresses": lambda s, d: filled(s, d).addresses.table,
        "store_addresses_of": lambda s, d: filled(s, d).addresses_of(KEY),
        "store_ids_of": lambda s, d: filled(s, d).ids_of(padded_text()),
        "store_address_by_index": lambda s, d: (lambda r: lookup.find_address(r.addresses.find("address", 0x72656D6F74737543, by_index=True), padded_text()))(filled(s, d)),
        "ledger_transactions": lambda s, d: ingested(s, d).transactions.table,
        "ledger_addresses": lambda s, d: ingested(s, d).addresses.table,
        "ledger_block_log": lambda s, d: ingested(s, d).block_log.table.select("seq", "block"),
        "ledger_replay": replayed,
        "ledger_crash_and_replay": crashed,
        "ledger_stream": streamed_ledger,
        "block_log_reopened": lambda s, d: event_log(s, d).block_log.table.select("seq", "block"),
        "block_log_text": lambda s, d: block_text.read_lines(s, log_text(s, d)).groupBy("block").agg(F.count("*").alias("n")),
        "block_log_tail": log_tail,
        "block_log_stream": streamed_log,
        "fixed_width_transactions": lambda s, d: exported(s, transactions(s, d), "transactions"),
        "fixed_width_addresses": lambda s, d: exported(s, addresses(s, d), "addresses"),
        "base58_decode": lambda s, d: table(s, d, "customer").select("c_custkey", F.lower(F.hex(base58_decode(base58_text()))).alias("hex")),
        "splitmix64": lambda s, d: table(s, d, "customer").select("c_custkey", splitmix64(F.col("c_custkey").cast("long"), F.lit(3).cast("long")).alias("draw")),
    }
    return q


#: DuckDB's UHUGEINT holds a product of two 64-bit values.
M64 = "18446744073709551616::UHUGEINT"


def draw_sql(seed: str, index: str) -> str:
    """The index-th draw of splitmix64, as UHUGEINT under 2^64."""
    steps = [f"(({seed})::UHUGEINT + (({index})::UHUGEINT + 1) * {GAMMA}::UHUGEINT) % {M64}"]
    for shift, factor in ((30, MIX_1), (27, MIX_2)):
        steps.append(f"(xor(z, z // {1 << shift}::UHUGEINT) * {factor}::UHUGEINT) % {M64}")
    steps.append(f"xor(z, z // {1 << 31}::UHUGEINT)")
    out = steps[0]
    for step in steps[1:]:
        out = f"list_transform([{out}], lambda z: {step})[1]"
    return out


def signed_sql(x: str) -> str:
    return f"CASE WHEN {x} >= 9223372036854775808::UHUGEINT THEN ({x}::HUGEINT - 18446744073709551616::HUGEINT)::BIGINT ELSE {x}::BIGINT END"


def oracle_sql() -> dict[str, str]:
    tx = lambda sql: f"WITH {TX} {sql}"
    addr = lambda sql: f"WITH {ADDR} {sql}"
    padded = f"rpad('{TEXT}', {ADDRESS_LENGTH}, 'A')"
    ledger = f"WITH {BATCH}, known AS (SELECT address, arg_min(id, o) AS id FROM (SELECT ordinal AS o, id, address FROM stored UNION ALL SELECT seq * 4 + pos + 1000000000, id, address FROM fresh) GROUP BY address)"
    changes = "SELECT row_number() OVER (ORDER BY seq) - 1 AS seq, block FROM (SELECT seq, block, lag(block) OVER (ORDER BY seq) AS b FROM {}) WHERE block IS DISTINCT FROM b"
    days = "(SELECT o_orderkey AS seq, date_diff('day', DATE '1995-01-01', o_orderdate)::BIGINT AS block FROM orders)"
    resolved = f"""SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS ordinal, a.id AS v0, b.id AS v1, o_orderkey - 1 AS v2, o_orderkey AS v3, (date_diff('day', DATE '1995-01-01', o_orderdate)::BIGINT << 43) | CAST(round(o_totalprice * 100) AS BIGINT) AS v4
FROM orders JOIN known a ON a.address = rpad('c' || o_custkey, {ADDRESS_LENGTH}, 'A') JOIN known b ON b.address = rpad('k' || (o_orderkey % 100), {ADDRESS_LENGTH}, 'A')"""
    five = ", ".join(f"{draw_sql('1', f'id * 5 + {k}')} AS d{k}" for k in range(5))
    letters = f"list_transform(range(0, {ADDRESS_LENGTH}), lambda i: substr('{ADDRESS_ALPHABET}', 1 + ({draw_sql(f'id + {ADDRESS_SEED}', 'i')} % {len(ADDRESS_ALPHABET)}::UHUGEINT)::BIGINT, 1))"
    out: dict[str, str] = {}
    for name, value in {"v0": KEY, "v1": 107, "v2": 1000, "v3": 1000}.items():
        out[f"store_find_by_{name}"] = tx(f"SELECT * FROM tx WHERE {name} = {value}")
        out[f"store_postings_{name}"] = tx(f"SELECT {name} AS key, ordinal FROM tx")
    names = ", ".join(f"('{k}', {v})" for k, v in OPTIONS.__dict__.items() if not isinstance(v, bool))
    hexed = f"lower(to_hex(list_reduce(list_transform(string_split(translate(c_name, '#0', 'zA'), ''), lambda c: (strpos('{BASE58_ALPHABET}', c) - 1)::HUGEINT), lambda a, d: a * 58 + d)))"
    out |= {
        "store_scan": tx("SELECT * FROM tx"),
        "store_find_missing": tx("SELECT * FROM tx WHERE v0 = -1"),
        "store_find_ordinals": tx(f"SELECT ordinal FROM tx WHERE v0 = {KEY}"),
        "store_counts": f"SELECT count(*) AS n, count(*) AS committed, count(*) AS covered, count(*) FILTER (o_custkey = {KEY}) AS hits, 0 AS misses, (SELECT count(*) FROM customer) AS addresses FROM orders",
        "store_read": tx("SELECT * FROM tx WHERE ordinal = 100"),
        "store_read_range": tx("SELECT * FROM tx WHERE ordinal BETWEEN 200 AND 249"),
        "store_statistics": "SELECT 'index-v' || i AS name, 3 AS segment_count, 0 AS pending_count, (SELECT count(*) FROM orders) AS covered_up_to, 'transactions' AS store FROM (SELECT unnest(range(0, 4)) AS i) UNION ALL SELECT 'index-' || n, 1, 0, (SELECT count(*) FROM customer), 'addresses' FROM (SELECT unnest(['id', 'address']) AS n)",
        "store_compacted_postings": tx("SELECT v0 AS key, ordinal FROM tx"),
        "store_maintenance": "SELECT 4 * count(*) AS planned, 4 * count(*) AS done, 4 * count(*) AS last_done, 100.0::DOUBLE AS last_percentage, 4 AS stages, 0 AS misplaced, 12 AS vacuumed, 12 AS before, 4 AS after, 0 AS left_over FROM orders",
        "store_rebuilt_postings": tx("SELECT v2 AS key, ordinal FROM tx"),
        "store_pending": f"SELECT 'pending' AS state, count(*) + count(*) FILTER (o_orderkey % 2 = 0) AS n, count(*) AS committed, count(*) FILTER (o_custkey = {KEY}) + count(*) FILTER (o_custkey = {KEY} AND o_orderkey % 2 = 0) AS hits FROM orders UNION ALL SELECT 'reopened', count(*), count(*), count(*) FILTER (o_custkey = {KEY}) FROM orders",
        "store_own_schema": f"SELECT * FROM (SELECT row_number() OVER (ORDER BY s_suppkey) - 1 AS ordinal, s_suppkey, s_nationkey FROM supplier) WHERE s_nationkey = {KEY}",
        "store_options": f"SELECT * FROM (VALUES {names}) t(name, value)",
        "store_addresses": addr("SELECT * FROM addr"),
        "store_addresses_of": addr(f"SELECT address FROM addr WHERE id = {KEY}"),
        "store_ids_of": addr(f"SELECT id FROM addr WHERE address = {padded}"),
        "store_address_by_index": addr(f"SELECT * FROM addr WHERE address = {padded}"),
        "ledger_transactions": f"{ledger} {resolved}",
        "ledger_addresses": f"WITH {BATCH} SELECT row_number() OVER (ORDER BY k, seq, pos) - 1 AS ordinal, id, address FROM (SELECT 0 AS k, ordinal AS seq, 0 AS pos, id, address FROM stored UNION ALL SELECT 1, seq, pos, id, address FROM fresh)",
        "ledger_block_log": changes.format(days),
        "ledger_replay": f"SELECT count(*) AS n, sum(o_orderkey)::BIGINT AS total, (SELECT count(*) FROM ({changes.format(days)})) AS changes FROM orders",
        "ledger_crash_and_replay": f"SELECT count(*) AS n, (SELECT count(*) FROM ({changes.format(days)})) AS changes, (SELECT arg_max(block, seq) FROM {days}) AS logged FROM orders",
        "ledger_stream": f"{ledger.replace('WHERE c_custkey % 2 = 0', 'WHERE false')} {resolved}",
        "block_log_reopened": f"WITH {LOG} {changes.format('blocks')}",
        "block_log_text": f"WITH {LOG} SELECT block, count(*) AS n FROM ({changes.format('blocks')}) GROUP BY block",
        "block_log_tail": f"WITH {LOG} SELECT arg_max(block, seq) AS block FROM blocks",
        "block_log_stream": f"WITH {LOG} SELECT seq, block FROM (SELECT seq, block, lag(block) OVER (ORDER BY seq) AS b FROM blocks) WHERE block IS DISTINCT FROM b",
        "fixed_width_transactions": tx("SELECT * FROM tx"),
        "fixed_width_addresses": addr("SELECT * FROM addr"),
        "base58_decode": f"SELECT c_custkey, CASE WHEN length(h) % 2 = 1 THEN '0' || h ELSE h END AS hex FROM (SELECT c_custkey, {hexed} AS h FROM customer)",
        "synthetic_transactions": f"SELECT id AS seq, {', '.join(f'(d{k} % 1250::UHUGEINT)::BIGINT AS v{k}' for k in range(3))}, {', '.join(f'{signed_sql(f"d{k}")} AS v{k}' for k in (3, 4))} FROM (SELECT id, {five} FROM (SELECT unnest(range(0, 10000)) AS id))",
        "synthetic_addresses": f"SELECT id AS seq, id, array_to_string({letters}, '') AS address FROM (SELECT unnest(range(0, 1000)) AS id)",
        "splitmix64": f"SELECT c_custkey, {signed_sql('d')} AS draw FROM (SELECT c_custkey, {draw_sql('c_custkey', '3')} AS d FROM customer)",
    }
    return out
