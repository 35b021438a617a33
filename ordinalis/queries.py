"""The store's operators as queries over the driver's tables, each with the SQL that says the same.

Orders make the transactions, customers the addresses, events the stream of blocks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import codecs
from .model import ADDRESS_LENGTH
from .operators import ingest, lookup
from .operators.numbering import number_rows
from .sources import synthetic
from .sources.scratch import fresh_path

KEY, BLOCK, ADDRESS_ID = 7, 100, 7
TEXT = "Customer#000000007"
HEX_TEXTS = ["ff", "FF", "0xff", "0XFF", "00000000000000ff", "ffffffffffffffff", "", "0x", "g", "12g4", " ff", "ff ", "-1", "10000000000000000", "7fffffffffffffff"]
BASE58 = {"161BqpuSRgdoGqiK78AfUqQi72dZtMyaaE": ("0036e1ade159a92895293b45804642df3e5d027a18b627a10b", 8890536261305232884), "1LyNyE6BVgwYnDGtFd3DC2W4SVfx2yYvAU": ("00db1405dc258d3ee32e249bdbd02720795301c09acd548751", 5537646333184676354)}

TX = """tx AS (
  SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS ordinal, o_custkey AS v0, (o_custkey + o_orderkey) % 1000 AS v1,
         coalesce(lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey), 0) AS v2, o_orderkey AS v3,
         (date_diff('day', DATE '1995-01-01', o_orderdate)::BIGINT << 43) | CAST(round(o_totalprice * 100) AS BIGINT) AS v4
  FROM orders)"""
ADDR = f"addr AS (SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS ordinal, c_custkey AS id, rpad(c_name, {ADDRESS_LENGTH}, 'A') AS address FROM customer)"
LOG = "blocks AS (SELECT event_id AS seq, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS block FROM events)"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


_stored: dict[tuple, str] = {}


def files_of(spark: SparkSession, folder: str, name: str) -> tuple[str, ...]:
    """The table's files with their sizes and times of change: what is kept for a folder is made anew if they differ."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.parquet")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    return tuple(f"{x.getPath()} {x.getLen()} {x.getModificationTime()}" for x in found)


def stored(spark: SparkSession, folder: str, name: str, source: str, make: Callable[[], DataFrame], order: str) -> DataFrame:
    """The table with ordinals, as a store keeps it: numbered and written once for a session and the source's files, then read by all queries."""
    key = (spark.sparkContext.applicationId, name, *files_of(spark, folder, source))
    if key not in _stored:
        numbered, _ = number_rows(make(), order)
        path = fresh_path(spark, name)
        numbered.sortWithinPartitions("ordinal").write.parquet(path)
        _stored[key] = path
    return spark.read.parquet(_stored[key])


def transactions(spark: SparkSession, folder: str) -> DataFrame:
    def make() -> DataFrame:
        rows = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
        before = F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
        block = F.datediff("o_orderdate", F.lit("1995-01-01").cast("date")).cast("long")
        cents = F.round(F.col("o_totalprice") * 100).cast("long")
        return rows.select(F.col("o_custkey").alias("v0"), ((F.col("o_custkey") + F.col("o_orderkey")) % 1000).alias("v1"), F.coalesce(before, F.lit(0)).alias("v2"), F.col("o_orderkey").alias("v3"), F.shiftleft(block, 43).bitwiseOR(cents).alias("v4"))

    return stored(spark, folder, "transactions", "orders", make, "v3").select("ordinal", "v0", "v1", "v2", "v3", "v4")


def transactions_by_order(spark: SparkSession, folder: str) -> DataFrame:
    """v0, v3 and v4 without ordinals, for operators that need none: the scan feeds them directly."""
    rows = table(spark, folder, "orders")
    block = F.datediff("o_orderdate", F.lit("1995-01-01").cast("date")).cast("long")
    return rows.select(F.col("o_custkey").alias("v0"), ((F.col("o_custkey") + F.col("o_orderkey")) % 1000).alias("v1"), F.col("o_orderkey").alias("v3"), block.alias("block"), F.round(F.col("o_totalprice") * 100).cast("long").alias("amount"))


def addresses(spark: SparkSession, folder: str) -> DataFrame:
    make = lambda: table(spark, folder, "customer").select(F.col("c_custkey").alias("id"), codecs.padded_address(F.col("c_name")).alias("address"))
    return stored(spark, folder, "addresses", "customer", make, "id").select("ordinal", "id", "address")


def blocks(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select(F.col("event_id").alias("seq"), F.floor(F.unix_timestamp("ts") / 3600).cast("long").alias("block"))


def ledger_batch(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as ledger rows: customers pay clerks of a hundred; each order's text is its transaction."""
    key = F.col("o_orderkey")
    return table(spark, folder, "orders").select(
        key.alias("seq"),
        (F.col("o_custkey") + 1_000_000).alias("from_short"),
        F.concat(F.lit("c"), F.col("o_custkey")).alias("from"),
        (key % 100).alias("to_short"),
        F.concat(F.lit("k"), key % 100).alias("to"),
        (key - 1).alias("prev_short"),
        F.concat(F.lit("t"), key - 1).alias("prev_tx"),
        key.alias("tx_short"),
        F.concat(F.lit("t"), key).alias("tx"),
        F.round(F.col("o_totalprice") * 100).cast("long").alias("amount"),
        F.datediff("o_orderdate", F.lit("1995-01-01").cast("date")).cast("long").alias("block"),
    )


def stored_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Addresses of even customers, as a store has them before the batch."""
    rows = table(spark, folder, "customer").where("c_custkey % 2 = 0")
    return rows.select(F.col("c_custkey").alias("ordinal"), (F.col("c_custkey") + 5).alias("id"), codecs.padded_address(F.concat(F.lit("c"), F.col("c_custkey"))).alias("address"))


def inserted(spark: SparkSession, folder: str) -> DataFrame:
    return ingest.addresses_to_insert(ledger_batch(spark, folder), stored_texts(spark, folder))


def resolved(spark: SparkSession, folder: str) -> DataFrame:
    new = inserted(spark, folder).select((F.col("seq") * 4 + F.col("pos") + 1_000_000_000).alias("ordinal"), "id", "address")
    known = stored_texts(spark, folder).unionByName(new)
    return ingest.resolve_transactions(ledger_batch(spark, folder), known).drop("block")


PAD = f"CASE WHEN length(x) < {ADDRESS_LENGTH} THEN rpad(x, {ADDRESS_LENGTH}, f) ELSE x END"
BATCH = f"""stored AS (SELECT c_custkey AS ordinal, c_custkey + 5 AS id, rpad('c' || c_custkey, {ADDRESS_LENGTH}, 'A') AS address FROM customer WHERE c_custkey % 2 = 0),
four AS (SELECT o_orderkey AS seq, 0 AS pos, o_custkey + 1000000 AS id, 'c' || o_custkey AS x, 'A' AS f FROM orders
  UNION ALL SELECT o_orderkey, 1, o_orderkey % 100, 'k' || (o_orderkey % 100), 'A' FROM orders
  UNION ALL SELECT o_orderkey, 2, o_orderkey - 1, 't' || (o_orderkey - 1), 'T' FROM orders
  UNION ALL SELECT o_orderkey, 3, o_orderkey, 't' || o_orderkey, 'T' FROM orders),
padded AS (SELECT seq, pos, id, {PAD} AS address FROM four),
ranked AS (SELECT *, row_number() OVER (PARTITION BY address ORDER BY seq, pos) AS n FROM padded),
fresh AS (SELECT seq, pos, id, address FROM ranked WHERE n = 1 AND NOT EXISTS (SELECT 1 FROM stored s WHERE s.address = ranked.address))"""


def probes(spark: SparkSession) -> DataFrame:
    return spark.range(0, 400, 4).select(F.col("id").alias("probe"))


def hex_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Keys of orders in hexadecimal, a fifth each plain, with a prefix, in capitals, and two that don't parse."""
    key, digits = F.col("o_orderkey") % 5, codecs.to_hex(F.col("o_orderkey"), padded=False)
    spelled = F.when(key == 0, digits).when(key == 1, F.concat(F.lit("0x"), digits)).when(key == 2, F.upper(digits)).when(key == 3, F.concat(digits, F.lit("g"))).otherwise(F.concat(F.lit(" "), digits))
    return table(spark, folder, "orders").select(spelled.alias("s"))


def texts(spark: SparkSession, values: list[str]) -> DataFrame:
    return spark.createDataFrame([(v,) for v in values], "s string")


def run_of(spark: SparkSession, folder: str, key: str) -> DataFrame:
    """A sorted run of an index over the stored transactions, written once: key, ordinal."""

    def write() -> str:
        path = fresh_path(spark, f"run-{key}")
        rows = transactions(spark, folder).select(F.col(key).alias("key"), "ordinal")
        rows.repartitionByRange("key", "ordinal").sortWithinPartitions("key", "ordinal").write.option("parquet.bloom.filter.enabled#key", "true").parquet(path)
        return path

    name = (spark.sparkContext.applicationId, f"run-{key}", *files_of(spark, folder, "orders"))
    if name not in _stored:
        _stored[name] = write()
    return spark.read.schema("key long, ordinal long").parquet(_stored[name])


def by_index_run(spark: SparkSession, folder: str) -> DataFrame:
    """Ordinals from a sorted run of postings, then their rows, by ordinal."""
    hits = lookup.find_ordinals(run_of(spark, folder, "v0"), "key", KEY)
    return lookup.rows_at(transactions(spark, folder), hits)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    values = {"v0": KEY, "v1": 107, "v2": 1000, "v3": 1000}
    for name, value in values.items():
        q[f"find_by_{name}"] = lambda s, d, n=name, v=value: lookup.find(transactions(s, d), n, v)
        q[f"find_ordinals_by_{name}"] = lambda s, d, n=name, v=value: lookup.find_ordinals(transactions(s, d), n, v)
        q[f"count_by_{name}"] = lambda s, d, n=name, v=value: lookup.count_by(transactions_by_order(s, d) if n != "v2" else transactions(s, d), n, v)
    q |= {
        "find_missing_key": lambda s, d: lookup.find(transactions(s, d), "v0", 2**64 - 1),
        "read_ordinal": lambda s, d: transactions(s, d).where(F.col("ordinal") == 100),
        "read_range": lambda s, d: transactions(s, d).where(F.col("ordinal").between(200, 249)).orderBy("ordinal"),
        "record_count": lambda s, d: table(s, d, "orders").agg(F.count("*").alias("n")),
        "field_by_position": lambda s, d: (lambda t: t.select("ordinal", lookup.field(t, 3).alias("value")))(transactions(s, d)),
        "find_by_id": lambda s, d: lookup.find(addresses(s, d), "id", ADDRESS_ID),
        "try_get_address": lambda s, d: lookup.first_match(lookup.find(addresses(s, d), "id", ADDRESS_ID)).select("address"),
        "find_by_address": lambda s, d: lookup.find_address(addresses(s, d), TEXT.ljust(ADDRESS_LENGTH, "A")),
        "try_get_id": lambda s, d: lookup.first_match(lookup.find_address(addresses(s, d), TEXT.ljust(ADDRESS_LENGTH, "A"))).select("id"),
        "address_prefix_candidates": lambda s, d: lookup.prefix_candidates(addresses(s, d), TEXT),
        "first_match": lambda s, d: lookup.first_match(lookup.find(transactions(s, d), "v0", KEY)),
        "last_match": lambda s, d: lookup.last_match(lookup.find(transactions(s, d), "v0", KEY)),
        "limit_20": lambda s, d: transactions(s, d).orderBy("ordinal").limit(20),
        "pack_unpack": lambda s, d: (lambda p: transactions_by_order(s, d).select("v3", p.alias("v4"), codecs.block_of(p).alias("block"), codecs.amount_of(p).alias("amount")))(codecs.pack(F.col("block"), F.col("amount"))),
        "transactions_in_packed_block": lambda s, d: lookup.transactions_in_packed_block(transactions(s, d), BLOCK),
        "transactions_by_packed_amount": lambda s, d: lookup.transactions_by_packed_amount(transactions(s, d).withColumn("v4", F.col("v4") % 1000 + F.shiftleft(codecs.block_of(F.col("v4")), 43)), KEY),
        "hex_padded": lambda s, d: transactions_by_order(s, d).select("v3", codecs.to_hex(F.col("v3")).alias("hex")),
        "hex_unpadded": lambda s, d: transactions_by_order(s, d).select("v3", codecs.to_hex(F.col("v3"), padded=False).alias("hex")),
        "hex_try_parse": lambda s, d: hex_texts(s, d).unionByName(texts(s, HEX_TEXTS)).select("s", codecs.to_hex(codecs.try_parse_hex(F.col("s"))).alias("value")),
        "address_prefix": lambda s, d: table(s, d, "customer").select("c_custkey", codecs.address_prefix(F.reverse("c_name")).alias("prefix")),
        "address_is_valid": lambda s, d: table(s, d, "customer").select("c_custkey", codecs.address_is_valid(F.when(F.col("c_custkey") % 2 == 0, codecs.padded_address(F.col("c_name"))).otherwise(F.col("c_name"))).alias("valid")),
        "pad_address": lambda s, d: table(s, d, "customer").select("c_custkey", codecs.padded_address(F.col("c_name")).alias("a"), codecs.padded_tx(F.repeat("c_name", F.lit(5))).alias("t")),
        "base58_short_id": lambda s, d: table(s, d, "customer").select(F.translate("c_name", "#0", "zA").alias("s")).unionByName(texts(s, list(BASE58))).select("s", codecs.base58_short_id(F.col("s")).alias("id")),
        "base58_binary": lambda s, d: table(s, d, "customer").select("c_custkey", codecs.to_binary_digits(F.encode("c_name", "UTF-8"), little_endian=True, grouped=True).alias("bits")),
        "reverse_hex": lambda s, d: table(s, d, "customer").select("c_custkey", codecs.reversed_hex(F.encode("c_name", "UTF-8")).alias("hex")),
        "block_log": lambda s, d: ingest.block_changes(blocks(s, d)),
        "last_logged_block": lambda s, d: blocks(s, d).agg(F.max_by("block", "seq").alias("block")),
        "addresses_to_insert": lambda s, d: inserted(s, d).withColumn("pos", F.col("pos").cast("long")),
        "resolve_canonical_ids": resolved,
        "ingest_clamp": lambda s, d: transactions_by_order(s, d).select("v3", codecs.amount_of(codecs.pack(F.col("block"), F.col("amount") * 1_000_000)).alias("amount")),
        "probe_counts": lambda s, d: lookup.probe_counts(probes(s), transactions_by_order(s, d), "v0", 100),
        "index_key_stats": lambda s, d: lookup.key_statistics(transactions(s, d), {f"v{i}": F.col(f"v{i}") for i in range(4)}),
        "bag_union_segments": lambda s, d: (lambda t: lookup.union_runs([t.where("ordinal < 500"), t.where("ordinal between 500 and 899"), t.where("ordinal >= 900")]))(run_of(s, d, "v0")),
        "index_rebuild_tail": lambda s, d: transactions(s, d).where("ordinal >= 1000").select(F.col("v1").alias("key"), "ordinal"),
        "find_by_index_run": by_index_run,
        "from_hex": lambda s, d: transactions_by_order(s, d).select("v3", codecs.from_hex(F.concat(F.lit(" 000"), codecs.to_hex(F.col("v3")), F.lit(" "))).alias("value")),
        "tx_short_id": lambda s, d: transactions_by_order(s, d).select("v3", codecs.tx_short_id(F.concat(codecs.to_hex(F.col("v3")), F.lit("ffff"))).alias("short")),
        "unsigned_decimal": lambda s, d: transactions_by_order(s, d).select("v3", codecs.unsigned(-F.col("v3") - 1).cast("string").alias("value")),
        "hex_of_bytes": lambda s, d: table(s, d, "customer").select("c_custkey", codecs.hex_of_bytes(F.encode("c_name", "UTF-8")).alias("hex")),
        "address_with_prefix": lambda s, d: table(s, d, "customer").select("c_custkey", codecs.address_with_prefix(F.substring("c_name", 1, 8), "f").alias("address")),
        "canonical_ids": lambda s, d: ingest.canonical_ids(addresses(s, d).withColumn("address", F.regexp_replace("address", "[0-9]A*$", ""))),
        "resolve_packed_blocks": lambda s, d: transactions(s, d).groupBy(codecs.block_of(F.col("v4")).alias("block")).agg(F.count("*").alias("n"), F.sum(codecs.amount_of(F.col("v4"))).alias("amount")),
        "synthetic_transactions": lambda s, d: synthetic.transactions(s, 10_000),
        "synthetic_addresses": lambda s, d: synthetic.addresses(s, 1_000),
    }
    return q


def oracle_sql() -> dict[str, str]:
    tx = lambda sql: f"WITH {TX} {sql}"
    addr = lambda sql: f"WITH {ADDR} {sql}"
    padded = f"rpad('{TEXT}', {ADDRESS_LENGTH}, 'A')"
    by_order = "SELECT o_custkey AS v0, o_orderkey AS v3, date_diff('day', DATE '1995-01-01', o_orderdate)::BIGINT AS block, CAST(round(o_totalprice * 100) AS BIGINT) AS amount FROM orders"
    out: dict[str, str] = {}
    for name, value in {"v0": KEY, "v1": 107, "v2": 1000, "v3": 1000}.items():
        out[f"find_by_{name}"] = tx(f"SELECT * FROM tx WHERE {name} = {value}")
        out[f"find_ordinals_by_{name}"] = tx(f"SELECT ordinal FROM tx WHERE {name} = {value}")
        out[f"count_by_{name}"] = tx(f"SELECT count(*) AS n FROM tx WHERE {name} = {value}")
    hex_keys = "SELECT CASE o_orderkey % 5 WHEN 0 THEN h WHEN 1 THEN '0x' || h WHEN 2 THEN upper(h) WHEN 3 THEN h || 'g' ELSE ' ' || h END FROM (SELECT o_orderkey, lower(to_hex(o_orderkey)) AS h FROM orders)"
    # the decoded number in hexadecimal, its bytes in reverse, and sixteen nibbles from the sixth on as a signed value
    number = f"list_reduce(list_transform(string_split(s, ''), lambda c: (strpos('{codecs.BASE58_ALPHABET}', c) - 1)::HUGEINT), lambda a, x: a * 58 + x)"
    nibbles = "list_transform(range(1, 17), lambda i: (strpos('0123456789abcdef', substr(r, i + 5, 1)) - 1)::HUGEINT)"
    short_ids = f"""SELECT s, CASE WHEN v >= 9223372036854775808::HUGEINT THEN (v - 18446744073709551616::HUGEINT)::BIGINT ELSE v::BIGINT END FROM (
  SELECT s, list_reduce({nibbles}, lambda a, x: a * 16 + x) AS v FROM (
    SELECT s, array_to_string(list_reverse(list_transform(range(0, (length(h) / 2)::BIGINT), lambda i: substr(h, 2 * i + 1, 2))), '') AS r FROM (
      SELECT s, CASE WHEN length(x) % 2 = 1 THEN '0' || x ELSE x END AS h FROM (SELECT s, lower(to_hex({number})) AS x FROM (SELECT translate(c_name, '#0', 'zA') AS s FROM customer)))))"""
    hex_rows = ", ".join("('" + x + "')" for x in HEX_TEXTS)
    base_rows = ", ".join(f"('{k}', {v[1]})" for k, v in BASE58.items())
    # the prefix as a sum of eight bytes; the top one stays under 128
    prefix = " | ".join(f"(ascii(substr(reverse(c_name), {i + 1}, 1))::BIGINT << {8 * i})" for i in range(8))
    out |= {
        "find_missing_key": tx("SELECT * FROM tx WHERE v0 = -1"),
        "read_ordinal": tx("SELECT * FROM tx WHERE ordinal = 100"),
        "read_range": tx("SELECT * FROM tx WHERE ordinal BETWEEN 200 AND 249"),
        "record_count": "SELECT count(*) AS n FROM orders",
        "field_by_position": tx("SELECT ordinal, v3 AS value FROM tx"),
        "find_by_id": addr(f"SELECT * FROM addr WHERE id = {ADDRESS_ID}"),
        "try_get_address": addr(f"SELECT address FROM addr WHERE id = {ADDRESS_ID} ORDER BY ordinal LIMIT 1"),
        "find_by_address": addr(f"SELECT * FROM addr WHERE address = {padded}"),
        "try_get_id": addr(f"SELECT id FROM addr WHERE address = {padded} ORDER BY ordinal LIMIT 1"),
        "address_prefix_candidates": addr(f"SELECT * FROM addr WHERE substr(address, 1, 8) = '{TEXT[:8]}'"),
        "first_match": tx(f"SELECT * FROM tx WHERE v0 = {KEY} ORDER BY ordinal LIMIT 1"),
        "last_match": tx(f"SELECT * FROM tx WHERE v0 = {KEY} ORDER BY ordinal DESC LIMIT 1"),
        "limit_20": tx("SELECT * FROM tx ORDER BY ordinal LIMIT 20"),
        "pack_unpack": f"WITH t AS ({by_order}) SELECT v3, (block << 43) | amount AS v4, block, amount FROM t",
        "transactions_in_packed_block": tx(f"SELECT * FROM tx WHERE v4 >> 43 = {BLOCK}"),
        "transactions_by_packed_amount": tx(f"SELECT ordinal, v0, v1, v2, v3, v4 % 1000 + ((v4 >> 43) << 43) AS v4 FROM tx WHERE (v4 % 1000 + ((v4 >> 43) << 43)) & 8796093022207 = {KEY}"),
        "hex_padded": "SELECT o_orderkey AS v3, lpad(lower(to_hex(o_orderkey)), 16, '0') AS hex FROM orders",
        "hex_unpadded": "SELECT o_orderkey AS v3, lower(to_hex(o_orderkey)) AS hex FROM orders",
        "hex_try_parse": f"SELECT s, CASE WHEN regexp_full_match(s, '(0[xX])?[0-9a-fA-F]{{1,16}}') THEN lpad(lower(regexp_replace(s, '^0[xX]', '')), 16, '0') END AS value FROM (SELECT * FROM (VALUES {hex_rows}) t(s) UNION ALL {hex_keys})",
        "address_prefix": f"SELECT c_custkey, {prefix} AS prefix FROM customer",
        "address_is_valid": f"SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN length(rpad(c_name, {ADDRESS_LENGTH}, 'A')) ELSE length(c_name) END = {ADDRESS_LENGTH} AS valid FROM customer",
        "pad_address": f"SELECT c_custkey, rpad(c_name, {ADDRESS_LENGTH}, 'A') AS a, CASE WHEN length(repeat(c_name, 5)) < {ADDRESS_LENGTH} THEN rpad(repeat(c_name, 5), {ADDRESS_LENGTH}, 'T') ELSE repeat(c_name, 5) END AS t FROM customer",
        "base58_short_id": f"SELECT s, id::BIGINT AS id FROM (VALUES {base_rows}) t(s, id) UNION ALL {short_ids}",
        "base58_binary": "SELECT c_custkey, array_to_string([lpad(to_binary(ascii(c)), 8, '0') for c in string_split(reverse(c_name), '')], ' ') AS bits FROM customer",
        "reverse_hex": "SELECT c_custkey, lower(hex(encode(reverse(c_name)))) AS hex FROM customer",
        "block_log": f"WITH {LOG} SELECT seq, block FROM (SELECT seq, block, lag(block) OVER (ORDER BY seq) AS b FROM blocks) WHERE block IS DISTINCT FROM b",
        "last_logged_block": f"WITH {LOG} SELECT arg_max(block, seq) AS block FROM blocks",
        "addresses_to_insert": f"WITH {BATCH} SELECT seq, pos::BIGINT AS pos, id, address FROM fresh",
        "resolve_canonical_ids": f"""WITH {BATCH}, known AS (SELECT address, arg_min(id, ordinal) AS id FROM (SELECT ordinal, id, address FROM stored UNION ALL SELECT seq * 4 + pos + 1000000000, id, address FROM fresh) GROUP BY address)
SELECT o_orderkey AS seq, a.id AS v0, b.id AS v1, o_orderkey - 1 AS v2, o_orderkey AS v3, (date_diff('day', DATE '1995-01-01', o_orderdate)::BIGINT << 43) | CAST(round(o_totalprice * 100) AS BIGINT) AS v4
FROM orders JOIN known a ON a.address = rpad('c' || o_custkey, {ADDRESS_LENGTH}, 'A') JOIN known b ON b.address = rpad('k' || (o_orderkey % 100), {ADDRESS_LENGTH}, 'A')""",
        "ingest_clamp": f"WITH t AS ({by_order}) SELECT v3, least(amount * 1000000, 4398046511104) AS amount FROM t",
        "probe_counts": f"WITH t AS ({by_order}) SELECT p.probe, (SELECT count(*) FROM t WHERE t.v0 = p.probe) AS n FROM (SELECT unnest(range(0, 400, 4)) AS probe) p",
        "index_key_stats": tx(" UNION ALL ".join(f"SELECT 'v{i}' AS index, count(*) AS n, min(v{i}) AS min_key, max(v{i}) AS max_key FROM tx" for i in range(4))),
        "bag_union_segments": tx("SELECT v0 AS key, ordinal FROM tx"),
        "find_by_index_run": tx(f"SELECT * FROM tx WHERE v0 = {KEY}"),
        "from_hex": "SELECT o_orderkey AS v3, o_orderkey AS value FROM orders",
        "tx_short_id": "SELECT o_orderkey AS v3, o_orderkey AS short FROM orders",
        "unsigned_decimal": "SELECT o_orderkey AS v3, (18446744073709551615::HUGEINT - o_orderkey)::VARCHAR AS value FROM orders",
        "hex_of_bytes": "SELECT c_custkey, hex(encode(c_name)) AS hex FROM customer",
        "address_with_prefix": f"SELECT c_custkey, rpad(substr(c_name, 1, 8), {ADDRESS_LENGTH}, 'f') AS address FROM customer",
        "canonical_ids": addr("SELECT regexp_replace(address, '[0-9]A*$', '') AS address, arg_min(id, ordinal) AS id FROM addr GROUP BY 1"),
        "resolve_packed_blocks": tx("SELECT v4 >> 43 AS block, count(*) AS n, sum(v4 & 8796093022207)::BIGINT AS amount FROM tx GROUP BY 1"),
        "index_rebuild_tail": tx("SELECT v1 AS key, ordinal FROM tx WHERE ordinal >= 1000"),
    }
    return out
