"""Stores and roots: lookups against a model, reopening, faults, compaction, ingest, streams, the command line."""

import random

import pytest
from pyspark.sql import functions as F

from ordinalis import cli, ledger_queries
from ordinalis.model import ADDRESSES, TRANSACTIONS, StoreSpec, required
from ordinalis.operators import ingest, lookup
from ordinalis.plans.compaction import Progress, Run, makes_progress, next_merge, planned_entries
from ordinalis.root import LedgerRoot
from ordinalis.sources import fixed_width, synthetic
from ordinalis.sources import manifest as manifests
from ordinalis.sources.manifest import FILE, ManifestError, Segment
from ordinalis.sources.options import OptionsError, StoreOptions
from ordinalis.store import LedgerStore
from ordinalis.streaming.ingest import block_changes_stream, ingest_stream, log_stream

FIELDS = "seq long, v0 long, v1 long, v2 long, v3 long, v4 long"
BATCH = "seq long, from_short long, `from` string, to_short long, `to` string, prev_short long, prev_tx string, tx_short long, tx string, amount long, block long"
SMALL = StoreOptions(block_size=512, cache_budget_bytes=32 << 10, segment_size=4096, memtable_entries=1024, max_segment_entries=8192, merge_fanout=3, fence_stride=16, write_buffer_bytes=512)


def rows(spark, values):
    return spark.createDataFrame([(i, *v) for i, v in enumerate(values)], FIELDS)


def values(df):
    return [tuple(r) for r in df.collect()]


def test_lookups_and_reopen(spark, tmp_path):
    data = [(i % 25, i % 17, i % 13, i % 9, i) for i in range(2000)]
    with LedgerStore(spark, str(tmp_path), TRANSACTIONS) as store:
        assert store.append_range(rows(spark, data[:1500])) == 0 and store.append_range(rows(spark, data[1500:])) == 1500
        assert store.append_range(rows(spark, [])) == 2000 and store.committed_count == 0 and store.count == 2000
        assert store.count_by("v0", 3) == 80, "pending rows are seen"
    with LedgerStore(spark, str(tmp_path), TRANSACTIONS) as store:
        assert store.count == store.committed_count == 2000
        for k, n in enumerate((80, 118, 154, 222)):
            expected = [(i, *v) for i, v in enumerate(data) if v[k] == 3]
            assert values(store.find(f"v{k}", 3)) == values(store.find(f"v{k}", 3, by_index=True)) == expected and len(expected) == n
            assert [r[0] for r in values(store.find_ordinals(f"v{k}", 3))] == [e[0] for e in expected] and store.count_by(f"v{k}", 3) == n
        assert values(store.find("v0", 99)) == values(store.find("v0", 99, by_index=True)) == [] and store.count_by("v0", 99) == 0
        assert values(store.read(1234)) == [(1234, *data[1234])] and values(store.read_range(200, 50)) == [(i, *data[i]) for i in range(200, 250)]
        assert values(store.read_range(5000, 0)) == []
        for bad in (lambda: store.read(2000), lambda: store.read_range(1990, 11), lambda: store.read(-1)):
            with pytest.raises(IndexError):
                bad()
        assert [r.covered_up_to for r in store.index_statistics().collect()] == [2000] * 4
        plan = store.find("v0", 3)._jdf.queryExecution().executedPlan().toString()
        assert "EqualTo(v0,3)" in plan


def test_model(spark, tmp_path):
    r = random.Random(20250825)
    data = [(r.randrange(40), r.randrange(40), i, i % 7, 2 * i) for i in range(3000)] + [(2**64 - 1 - 2**64, -(2**63), 1, 2, 3)]
    store = LedgerStore(spark, str(tmp_path), TRANSACTIONS, SMALL)
    for at in range(0, len(data), 700):
        store.append_range(rows(spark, data[at : at + 700]))
    assert store.committed_count > 0, "a full store commits by itself"
    for key in (0, 7, 39):
        assert values(store.find("v0", key)) == [(i, *v) for i, v in enumerate(data) if v[0] == key]
        assert store.count_by("v1", key) == sum(v[1] == key for v in data)
    assert values(store.find("v0", 2**64 - 1)) == values(store.find("v1", 2**63, by_index=True)) == [(3000, *data[3000])]


def test_faults(spark, tmp_path):
    with LedgerStore(spark, str(tmp_path), TRANSACTIONS) as store:
        store.append_range(rows(spark, [(i % 11, i, i, i, i) for i in range(500)]))
    files = store.files
    lost = LedgerStore(spark, str(tmp_path), TRANSACTIONS)
    lost.append_range(rows(spark, [(1, 2, 3, 4, 5)]))  # never flushed
    files.delete("transactions/index-v0")
    with LedgerStore(spark, str(tmp_path), TRANSACTIONS) as store:
        assert store.count == 500 and store.count_by("v0", 0) == 46 and store.count_by("v0", 10) == 45
        assert store.vacuum() and store.vacuum() == [] and store.find("v1", 3).count() == 1
    files.delete(store.manifest.batches[0].path)
    with pytest.raises(ManifestError, match="missing"):
        LedgerStore(spark, str(tmp_path), TRANSACTIONS)
    files.write(f"transactions/{FILE}", "{ not json")
    with pytest.raises(ManifestError, match="read"):
        LedgerStore(spark, str(tmp_path), TRANSACTIONS)
    files.delete(f"transactions/{FILE}")
    files.make_folder("transactions/data/x")
    with pytest.raises(ManifestError, match="no manifest"):
        LedgerStore(spark, str(tmp_path), TRANSACTIONS)


def test_compaction_plan():
    runs = [Run(i, 0, 1024) for i in range(12)]
    assert planned_entries(runs, 3, 1024) == 0 and next_merge(runs, 3, 1024) == [] and not makes_progress(runs[:3], 1024)
    assert planned_entries(runs[:9], 3, 4096) == 9216 and planned_entries(runs[:2], 3, 4096) == 0
    assert [r.age for r in next_merge([Run(5, 1, 9), Run(4, 0, 1), Run(3, 0, 1), Run(2, 0, 1), Run(1, 0, 1)], 3, 100)] == [1, 2, 3]
    assert Progress("s", 0, 0).percentage == 100 and Progress("s", 3, 2).percentage == 100 and Progress("s", 1, 4).percentage == 25


def test_maintenance(spark, tmp_path):
    spec = StoreSpec("t", required(v0=TRANSACTIONS.fields["v0"].dataType), {"v0": lambda: F.col("v0")})
    store = LedgerStore(spark, str(tmp_path), spec, StoreOptions(merge_fanout=3, memtable_entries=1024, max_segment_entries=4096))
    for k in range(9):
        store.append_range(spark.range(1024).select(F.col("id").alias("seq"), (F.col("id") + k * 0).alias("v0")))
    seen = []
    assert len(store.manifest.indexes["v0"]) == 9 and store.planned_maintenance_entries() == 9216
    assert store.maintain(seen.append) == 9216 and len(store.manifest.indexes["v0"]) == 3 and seen[-1].percentage == 100 and seen[0].stage == "t/index-v0"
    assert store.count_by("v0", 0) == 9 and store.maintain() == 0
    assert [r.ordinal for r in store.find_ordinals("v0", 1023).collect()] == [1023 + 1024 * k for k in range(9)]
    assert len(store.vacuum()) == 9


def test_options(spark, tmp_path):
    for bad in ({"block_size": 1000}, {"block_size": 0}, {"merge_fanout": 1}, {"bloom_bits_per_key": 33}, {"fence_stride": 8}, {"memtable_entries": 10}, {"max_segment_entries": 1024}, {"segment_size": 1}, {"write_buffer_bytes": 1}, {"cache_budget_bytes": 1}):
        with pytest.raises(OptionsError):
            StoreOptions(**bad).validate()
    LedgerRoot(spark, str(tmp_path), SMALL).close()
    LedgerRoot(spark, str(tmp_path), SMALL).close()
    with pytest.raises(OptionsError, match="max_segment_entries"):
        LedgerRoot(spark, str(tmp_path), StoreOptions(**{**SMALL.__dict__, "max_segment_entries": 1 << 20}))
    (tmp_path / "options.json").write_text("{ not json")
    with pytest.raises(OptionsError, match="read"):
        LedgerRoot(spark, str(tmp_path), SMALL)
    with pytest.raises(ValueError, match="path"):
        LedgerRoot(spark, " ")


def simulate(batches, stored):
    """A row at a time: absent addresses appended, ids of the first row with the text."""
    addresses, transactions, log, last = list(stored), [], [], None
    for batch in batches:
        for _, fs, f, ts, t, ps, p, xs, x, amount, block in batch:
            for short, text, fill in ((fs, f, "A"), (ts, t, "A"), (ps, p, "T"), (xs, x, "T")):
                if text.ljust(65, fill) not in [a for _, a in addresses]:
                    addresses.append((short, text.ljust(65, fill)))
            first = {a: i for i, a in reversed(addresses)}
            transactions.append((first[f.ljust(65, "A")], first[t.ljust(65, "A")], ps, xs, block << 43 | min(amount, 2**42)))
            if block != last:
                log.append(block)
                last = block
    return addresses, transactions, log, last


def ledger_batches(seed=3):
    r = random.Random(seed)
    row = lambda i: (i, r.randrange(9), f"a{r.randrange(9)}", r.randrange(9), f"a{r.randrange(9)}", r.randrange(9), f"x{r.randrange(20)}", 100 + i, f"x{r.randrange(20)}", r.choice([5, 2**43]), 10 + r.randrange(3))
    return [[row(i) for i in range(30)], [row(i) for i in range(25)]]


def test_ledger(spark, tmp_path):
    stored, batches = [(77, "a1".ljust(65, "A")), (78, "a1".ljust(65, "A"))], ledger_batches()
    addresses, transactions, log, last = simulate(batches, stored)
    with LedgerRoot(spark, str(tmp_path)) as root:
        assert root.last_logged_block is None and values(root.block_log.table) == []
        for a in stored:
            root.add_address(*a)
        for b in batches:
            root.add_transactions(spark.createDataFrame(b, BATCH))
    with LedgerRoot(spark, str(tmp_path)) as root:
        assert values(root.addresses.table.orderBy("ordinal")) == [(i, *a) for i, a in enumerate(addresses)]
        assert values(root.transactions.table.orderBy("ordinal")) == [(i, *t) for i, t in enumerate(transactions)]
        assert [r.block for r in root.block_log.table.orderBy("seq").collect()] == log and root.last_logged_block == last
        assert all(len(line.value.split(" ")) == 2 and line.value.endswith("Z") for line in root.block_log.lines().collect())
        assert [r.address for r in root.addresses_of(77).collect()] == [stored[0][1]] and root.first_address(77) == stored[0][1] and root.first_address(10**6) is None
        assert [r.id for r in root.ids_of(stored[0][1]).collect()] == [77, 78] and root.first_id(stored[0][1]) == 77 and root.first_id("z" * 65) is None
        with pytest.raises(ValueError, match="65"):
            root.ids_of("short")
        with pytest.raises(Exception, match="doesn't fit"):
            root.add_address(1, "short")
        with pytest.raises(IndexError):
            root.transactions_by(4, 1)
        root.add_transaction(1, 2, 3, 4, last, 7)
        root.add_transaction(1, 2, 3, 4, last + 1, 2**43)
        assert [r.block for r in root.block_log.table.orderBy("seq").collect()] == [*log, last + 1]
        assert values(root.transactions_in_block(3).where("v0 = 1 and v3 = 4").select("v4")) == values(root.transactions_by_amount(4).where("v0 = 1 and v2 = 3").select("v4")) == [(last << 43 | 7,), (last + 1 << 43 | 2**42,)]
        assert root.transactions_in_packed_block(last + 1).where("v0 = 1 and v2 = 3").count() == 1 and root.transactions_by_packed_amount(7).count() == 1
        root.add_transaction(5, "b1", 6, "b2", 1, "y1", 2, "y2", 3, 4)
        assert root.addresses.count == len(addresses) + 4
        root.maintain()
        assert root.statistics().count() == 6 and root.planned_maintenance_entries() == 0


@pytest.mark.parametrize(("batches", "log"), [([[100] * 50 + [101]], [100, 101]), ([[10, 11, 10]], [10, 11, 10]), ([[200, 201], [201, 202]], [200, 201, 202]), ([[], [0]], [0])])
def test_block_log(spark, tmp_path, batches, log):
    for blocks in batches:
        with LedgerRoot(spark, str(tmp_path)) as root:
            root.block_log.log(spark.createDataFrame(list(enumerate(blocks)), "seq long, block long"))
    with LedgerRoot(spark, str(tmp_path)) as root:
        assert [tuple(r) for r in root.block_log.table.orderBy("seq").select("seq", "block").collect()] == list(enumerate(log))
        assert root.last_logged_block == (log[-1] if log else None)


def test_address_prefix_collision(spark, tmp_path):
    texts = ["deadbeef" + c * 57 for c in "123"]
    with LedgerStore(spark, str(tmp_path), ADDRESSES) as store:
        store.append(10, texts[0])
        store.append(20, texts[1])
        assert [lookup.find_address(store.table, t).select("id").collect() for t in texts] == [[(10,)], [(20,)], []]
        assert lookup.prefix_candidates(store.table, texts[0]).count() == 2 and store.count_by("address", 0x6665656264616564) == 2


def test_synthetic_and_fixed_width(spark, tmp_path):
    table = synthetic.transactions(spark, 1000, keys=10)
    assert table.where("v0 between 0 and 9 and v2 between 0 and 9").count() == 1000 and table.select("v3").distinct().count() == 1000
    numbered = table.withColumn("ordinal", F.col("seq")).drop("seq")
    people = synthetic.addresses(spark, 300, stored=5).select(F.col("seq").alias("ordinal"), "id", "address")
    for kind, df in (("transactions", numbered), ("addresses", people)):
        folder = tmp_path / kind
        folder.mkdir()
        for r in fixed_width.file_contents(df, kind, 4096).collect():
            data = bytes(r.content)
            (folder / r.name).write_bytes(data + b"torn" if r.name == max(x.name for x in [r]) and len(data) < 4000 else data)
        back = fixed_width.read_records(spark, str(folder), kind, 4096)
        assert len(list(folder.iterdir())) > 3 and sorted(values(back)) == sorted(values(df.select(back.columns)))


def test_stream(spark, tmp_path):
    batches = ledger_batches(9)
    source = str(tmp_path / "in")
    spark.createDataFrame(batches[0], BATCH).coalesce(1).write.parquet(source)
    with LedgerRoot(spark, str(tmp_path / "root")) as root:
        stream = spark.readStream.schema(spark.read.parquet(source).schema).parquet(source)
        ingest_stream(stream, root, "s", str(tmp_path / "c")).awaitTermination(120)
        spark.createDataFrame(batches[1], BATCH).coalesce(1).write.mode("append").parquet(source)
        ingest_stream(stream, root, "s", str(tmp_path / "c")).awaitTermination(120)
        addresses, transactions, log, _ = simulate(batches, [])
        assert values(root.transactions.table.orderBy("ordinal").drop("ordinal")) == transactions
        assert values(root.addresses.table.orderBy("ordinal").drop("ordinal")) == addresses
        assert [r.block for r in root.block_log.table.orderBy("seq").collect()] == log
        assert root.transactions.manifest.tokens == {"s": 1}
        # a replay of all, as after a lost checkpoint, does nothing
        ingest_stream(stream, root, "s", str(tmp_path / "again")).awaitTermination(120)
        assert root.transactions.count == 55


def test_block_changes_stream(spark, tmp_path):
    source = str(tmp_path / "in")
    (tmp_path / "in").mkdir()
    schema = "seq long, block long"
    stream = spark.readStream.schema(schema).parquet(source)
    for at, blocks in ((0, [5, 5, 6]), (3, [6, 5])):
        spark.createDataFrame([(at + i, b) for i, b in enumerate(blocks)], schema).coalesce(1).write.mode("append").parquet(source)
        keyed = block_changes_stream(stream.withColumn("chain", F.col("seq") % 2), "chain")
        query = keyed.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        query.awaitTermination(120)
        log_stream(stream, str(tmp_path / "log"), str(tmp_path / "c2")).awaitTermination(120)
    assert values(spark.read.parquet(str(tmp_path / "out")).orderBy("seq").select("key", "seq", "block")) == [("0", 0, 5), ("1", 1, 5), ("0", 2, 6), ("1", 3, 6), ("0", 4, 5)]
    log = lambda: values(spark.read.schema(schema).parquet(str(tmp_path / "log" / "batch=*")).orderBy("seq"))
    assert log() == [(0, 5), (2, 6), (4, 5)]
    for name in ("1", ".1.crc"):  # as after a crash before the stream's own commit: batch 1 runs again
        (tmp_path / "c2" / "commits" / name).unlink()
    log_stream(stream, str(tmp_path / "log"), str(tmp_path / "c2")).awaitTermination(120)
    assert log() == [(0, 5), (2, 6), (4, 5)]


def big_batch(n):
    return [(i, i % 7, f"a{i % 7}", i % 5, f"b{i % 5}", i, f"x{i}", i + 1, f"x{i + 1}", 5, 10 + i // 100) for i in range(n)]


@pytest.mark.parametrize("where", ["before the commit", "in the log", "in the manifest"])
def test_replay_after_a_crash(spark, tmp_path, monkeypatch, where):
    """A batch over the commit threshold, stopped at three places, is in once after its replay, by a new process or the same one."""
    options = StoreOptions(memtable_entries=1024, max_segment_entries=4096)
    batch = spark.createDataFrame(big_batch(1500), BATCH)

    def fail(*_, **__):
        raise RuntimeError("crash")

    root = LedgerRoot(spark, str(tmp_path), options)
    root.add_packed_transactions(spark.createDataFrame([(0, 1, 2, 3, 4, 9, 7)], "seq long, v0 long, v1 long, v2 long, v3 long, block long, amount long"))
    root.flush()
    with monkeypatch.context() as m:
        if where == "before the commit":
            m.setattr(root, "flush", fail)
        elif where == "in the log":
            m.setattr(root.block_log, "log", fail)
        else:
            write = manifests.write
            m.setattr(manifests, "write", lambda files, name, x: fail() if name == "transactions" else write(files, name, x))
        with pytest.raises(RuntimeError, match="crash"):
            root.add_transactions(batch, token=("s", 0))
    assert root.transactions.count == 1 and root.last_logged_block == 9, "the same process keeps nothing of it"
    for again in (root, LedgerRoot(spark, str(tmp_path), options), LedgerRoot(spark, str(tmp_path), options)):
        again.add_transactions(batch, token=("s", 0))
    with LedgerRoot(spark, str(tmp_path), options) as root:
        assert root.transactions.committed_count == 1501 and root.transactions.manifest.tokens == {"s": 0}
        assert root.addresses.count == 7 + 5 + 1501
        assert [tuple(r) for r in root.block_log.table.orderBy("seq").select("seq", "block").collect()] == [(0, 9), *((i + 1, 10 + i) for i in range(15))]


def test_runs_are_files(spark, tmp_path):
    """Flushes of uneven sizes: a run is a file of its own, and merges read what was planned."""
    spec = StoreSpec("t", required(v0=TRANSACTIONS.fields["v0"].dataType), {"v0": lambda: F.col("v0")})
    store = LedgerStore(spark, str(tmp_path), spec, StoreOptions(merge_fanout=4, memtable_entries=1024, max_segment_entries=1024))
    for n in (1100, 100, 1100, 100):
        store.append_range(spark.range(n).select(F.col("id").alias("seq"), (F.col("id") * 37 % 500).alias("v0")))
        store.flush()
    runs = store.manifest.indexes["v0"]
    assert [s.entries for s in runs] == [1024, 76, 100, 1024, 76, 100] and store.misplaced("v0") == 0
    for s in runs:
        read = spark.read.parquet(f"{tmp_path}/{s.path}").agg(F.count("*"), F.min("key"), F.max("key")).first()
        assert tuple(read) == (s.entries, s.min_key, s.max_key) and len([f for f in store.files.names(s.path) if f.endswith(".parquet")]) == 1
    assert runs[0].max_key <= runs[1].min_key
    planned = store.planned_maintenance_entries()
    assert planned and store.maintain() == planned and store.planned_maintenance_entries() == 0
    assert [r.ordinal for r in store.find_ordinals("v0", 37).collect()] == [k + base for base, n in ((0, 1100), (1100, 100), (1200, 1100), (2300, 100)) for k in range(n) if k * 37 % 500 == 37]
    kept = {s.path for s in store.manifest.indexes["v0"]}
    assert any(p.split("/piece=")[0] in {s.path.split("/piece=")[0] for s in runs} for p in store.vacuum()) and all(store.files.exists(p) for p in kept)
    shuffled = spark.createDataFrame([(5, 1), (3, 2), (4, 0)], "key long, ordinal long").coalesce(1)
    shuffled.write.parquet(f"{tmp_path}/t/index-v0/odd/piece=0")
    store.manifest.indexes["v0"] = [Segment("t/index-v0/odd/piece=0", 0, 3, 3, 3, 5)]
    assert store.misplaced("v0") == 1
    with pytest.raises(ManifestError, match="postings"):
        store._write_runs("v0", spark.range(5).selectExpr("id AS key", "id AS ordinal"), 0, 5, entries=6)


def test_fixed_width_faults(spark, tmp_path):
    table = synthetic.transactions(spark, 300, keys=10).withColumn("ordinal", F.col("seq")).drop("seq")
    folder = f"file://{tmp_path}/x"
    assert fixed_width.write_records(table, "transactions", 4096, folder) == 3
    assert sorted(values(fixed_width.read_records(spark, folder, "transactions", 4096))) == sorted(values(table.select("ordinal", "v0", "v1", "v2", "v3", "v4")))
    first, middle, last = (tmp_path / "x" / f"data{i:06d}.dat" for i in range(3))
    last.write_bytes(last.read_bytes() + b"torn")
    assert fixed_width.read_records(spark, folder, "transactions", 4096).count() == 300
    whole = middle.read_bytes()
    for data, message in ((whole[:-8], "short"), (whole + b"x" * 100, "larger")):
        middle.write_bytes(data)
        with pytest.raises(fixed_width.RecordFilesError, match=message):
            fixed_width.read_records(spark, folder, "transactions", 4096)
    middle.unlink()
    with pytest.raises(fixed_width.RecordFilesError, match="2 files"):
        fixed_width.read_records(spark, folder, "transactions", 4096)
    assert first.exists()


def test_three_sessions(spark, tmp_path):
    """Ingest, reopen and ingest more, merge, reopen and look everything up."""
    with LedgerRoot(spark, str(tmp_path), SMALL) as root:
        root.transactions.append_range(synthetic.transactions(spark, 1200, 40, root.transactions.count))
        root.addresses.append_range(synthetic.addresses(spark, 300, root.addresses.count))
    with LedgerRoot(spark, str(tmp_path), SMALL) as root:
        assert root.transactions.count == 1200 and root.addresses.count == 300
        root.transactions.append_range(synthetic.transactions(spark, 800, 40, root.transactions.count))
        root.addresses.append_range(synthetic.addresses(spark, 200, root.addresses.count))
        root.maintain()
    with LedgerRoot(spark, str(tmp_path), SMALL) as root:
        rows = values(root.transactions.table.orderBy("ordinal"))
        assert len(rows) == 2000 and [r[0] for r in rows] == list(range(2000))
        for key in (0, 39, 12):
            assert values(root.transactions_by(0, key, by_index=True)) == values(root.transactions_by(0, key)) == [r for r in rows if r[1] == key]
        for id_ in range(0, 500, 97):
            text = root.first_address(id_)
            assert len(text) == 65 and root.first_id(text) == id_


def test_block_changes_over_parts(spark):
    r = random.Random(1)
    blocks = [r.randrange(2) for _ in range(500)]
    df = spark.createDataFrame(list(enumerate(blocks)), "seq long, block long").repartition(7)
    expected = [(i, b) for i, b in enumerate(blocks) if b != ([1, *blocks])[i]]
    assert sorted(values(ingest.block_changes(df, last=1))) == expected


def test_scan_metrics(spark, tmp_path):
    from ordinalis.operators.metrics import scan_metrics

    path = str(tmp_path / "t")
    spark.range(1000).repartition(4).write.parquet(path)
    (found,) = scan_metrics(spark.read.parquet(path).where("id = 5"))
    assert found["numFiles"] == 4 and found["numOutputRows"] == 1000


def test_block_text(spark, tmp_path):
    from ordinalis.sources import block_text

    path = tmp_path / "log.txt"
    path.write_text("7 2025-01-02T03:04:05.678Z\nnonsense\n8 2025-01-02T03:04:06.000Z\n")
    rows = block_text.read_lines(spark, str(path)).orderBy("block").collect()
    assert [r.block for r in rows] == [7, 8] and rows[0].first_seen_ts.microsecond == 678000
    assert block_text.last_block(path.read_bytes()) == 8 and block_text.last_block(b"") is None and block_text.last_block(b"8 x\nbad\n") is None


def test_console_progress():
    import io

    out = io.StringIO()
    show = cli.ConsoleProgress(out)
    for i in range(101):
        show(Progress("s", i, 100))
    assert len(out.getvalue().splitlines()) == 11


def test_scratch_tables(spark):
    from ordinalis.sources import scratch

    paths = [scratch.fresh_path(spark, "t") for _ in range(2)]
    spark.range(3).write.parquet(paths[0])
    assert scratch.materialize(spark.range(5), "u").count() == 5
    made = len(scratch._made)
    held, scratch._made[:] = scratch._made[:-3], scratch._made[-3:]  # other tests' tables stay
    assert made >= 3 and scratch.release(spark) == 3 and scratch._made == []
    scratch._made[:] = held
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        spark.read.parquet(paths[0])


def test_command_line(spark, tmp_path, capsys):
    root = str(tmp_path / "r")
    assert cli.main(["ingest-transactions", root, "--count", "100", "--keys", "2"]) == 0
    assert cli.main(["ingest-addresses", root, "--count", "10"]) == 0
    assert cli.main(["find-v0", root, "1"]) == 0 and "found" in (out := capsys.readouterr().out) and "more" in out
    assert cli.main(["find-id", root, "3"]) == 0
    text = capsys.readouterr().out.strip()
    assert len(text) == 65 and cli.main(["find-address", root, text]) == 0 and capsys.readouterr().out.strip() == "3"
    assert cli.main(["find-id", root, "999"]) == 2 and cli.main(["find-address", root, "z" * 65]) == 2
    assert cli.main(["maintain", root]) == 0 and cli.main(["stats", root]) == 0 and "100 records x 40 bytes" in capsys.readouterr().out
    assert cli.main(["nonsense", root]) == 1 and cli.main(["find-v1", root]) == 1


def test_pending_rows_over_the_commit_threshold(spark, monkeypatch):
    """Rows that are as many as a store holds before it commits by itself stay pending in the query about pending rows."""
    duckdb = pytest.importorskip("duckdb")
    folder = "/root/testdata/sf0.01"
    monkeypatch.setattr(ledger_queries, "OPTIONS", StoreOptions(memtable_entries=1024, max_segment_entries=1 << 20, merge_fanout=3))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{folder}/orders.parquet'")
    found = values(ledger_queries.queries()["store_pending"](spark, folder))
    assert sorted(found) == sorted(con.execute(ledger_queries.oracle_sql()["store_pending"]).fetchall()) and found[0][1] - found[0][2] >= 1024
