"""An append-only table by ordinal with secondary indexes, kept as Parquet under a manifest.

Batches of rows and runs of sorted postings are folders; the manifest says which count. Writing a folder and then replacing the manifest is a
commit, so readers see whole commits, and what a crash leaves is ignored and can be vacuumed. Rows appended but not flushed are
visible to this store alone.
"""

from __future__ import annotations

from collections.abc import Callable
from copy import deepcopy
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .model import POSTING, StoreSpec, signed
from .operators import lookup
from .operators.numbering import number_rows
from .plans.compaction import Progress, Run, next_merge, planned_entries
from .sources import manifest as manifests
from .sources.files import Files
from .sources.manifest import Batch, Manifest, Segment
from .sources.options import StoreOptions

class LedgerStore:
    def __init__(self, spark: SparkSession, root: str, spec: StoreSpec, options: StoreOptions | None = None):
        self.spark, self.spec, self.options = spark, spec, (options or StoreOptions()).validate()
        self.files = Files(spark, root)
        self.files.make_folder(spec.name)
        self.manifest: Manifest = manifests.read(self.files, spec.name)
        if not self.files.exists(f"{spec.name}/{manifests.FILE}"):
            manifests.write(self.files, spec.name, self.manifest)  # so that what a crash leaves before the first commit is told from a lost manifest
        for b in self.manifest.batches:
            if not self.files.exists(b.path):
                raise manifests.ManifestError(f"{spec.name}: {b.path} is committed but missing")
        self.pending: list[Batch] = []
        self.closed = False
        self._replay()

    def __enter__(self) -> LedgerStore:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    def close(self) -> None:
        if not self.closed:
            self.flush()
            self.closed = True

    def _folder(self, kind: str) -> str:
        self.manifest.next_id += 1
        name = f"{self.spec.name}/{kind}/{self.manifest.next_id:08d}"
        while self.files.exists(name):  # left by a commit that never was
            self.manifest.next_id += 1
            name = f"{self.spec.name}/{kind}/{self.manifest.next_id:08d}"
        return name

    def _at(self, path: str) -> str:
        return f"{self.files.root}/{path}"

    @property
    def count(self) -> int:
        return self.manifest.committed + sum(b.rows for b in self.pending)

    @property
    def committed_count(self) -> int:
        return self.manifest.committed

    @property
    def table(self) -> DataFrame:
        """ordinal and the fields of all rows, pending ones included."""
        schema = "ordinal long, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in self.spec.fields)
        paths = [self._at(b.path) for b in self.manifest.batches + self.pending if b.rows]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    @property
    def full(self) -> bool:
        """Whether the pending rows are as many as a store holds before it commits by itself."""
        return sum(b.rows for b in self.pending) >= self.options.memtable_entries

    def append_range(self, rows: DataFrame, order: str = "seq", commit: bool = True) -> int:
        """Appends rows in the order of a column and returns the first ordinal; no rows change nothing.

        Rows are range-partitioned and written once with their place in their task, then once more with ordinals: the tasks' row counts, one
        number each, give each task its first. Files hold up to a segment. A full store commits by itself, unless commit is off, as
        where these rows belong to a larger commit.
        """
        fields = [f.name for f in self.spec.fields]
        first = self.count
        staged = self._folder("staged")
        picked = rows.select(F.col(order).alias("_order"), *fields)
        if self.spec.valid is not None:
            picked = picked.where(F.when(F.coalesce(self.spec.valid(), F.lit(False)), True).otherwise(F.raise_error(F.lit(f"a row doesn't fit {self.spec.name}")).cast("boolean")))
        try:
            placed, n = number_rows(picked, "_order", self._at(staged), first)
            if not n:
                return first
            path = self._folder("data")
            placed = placed.select("ordinal", *fields)
            per_file = max(1, self.options.segment_size // max(1, self.spec.row_bytes))
            self._bloomed(placed.sortWithinPartitions("ordinal").write.option("maxRecordsPerFile", per_file), [f for f in fields if f in self.spec.indexes]).parquet(self._at(path))
            self.pending.append(Batch(path, first, n))
        finally:
            self.files.delete(staged)
        if commit and self.full:
            self.flush()
        return first

    def append(self, *values: object) -> int:
        """Appends one row and returns its ordinal."""
        row = [signed(v) if isinstance(v, int) else v for v in values]
        return self.append_range(self.spark.createDataFrame([(0, *row)], "seq long, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in self.spec.fields)))

    def _bloomed(self, writer, columns: list[str]):
        if self.options.bloom_bits_per_key:
            for c in columns:
                writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true").option(f"parquet.bloom.filter.fpp#{c}", str(max(0.6185**self.options.bloom_bits_per_key, 1e-6)))
        return writer.option("parquet.page.row.count.limit", str(self.options.fence_stride))

    def flush(self, token: tuple[str, int] | None = None, attached: dict | None = None) -> None:
        """Commits pending rows and their postings: folders first, the manifest last.

        token: a stream's name and batch, and attached: state of the caller's, are committed in the same step.
        """
        if not self.pending and token is None and attached in (None, self.manifest.attached):
            return
        covered, made = self.count, {}
        if self.pending:
            table = self.spark.read.parquet(*[self._at(b.path) for b in self.pending])
            for name in self.spec.indexes:
                made[name] = self._write_runs(name, self._postings(table, name), 0, covered, sum(b.rows for b in self.pending))
        new = deepcopy(self.manifest)
        for name, runs in made.items():
            new.indexes.setdefault(name, []).extend(runs)
        new.batches, new.committed = new.batches + self.pending, covered
        if token:
            new.tokens[token[0]] = token[1]
        if attached is not None:
            new.attached = attached
        manifests.write(self.files, self.spec.name, new)
        self.manifest, self.pending = new, []

    def _postings(self, table: DataFrame, index: str) -> DataFrame:
        return table.select(self.spec.indexes[index]().alias("key"), "ordinal")

    def _write_runs(self, index: str, postings: DataFrame, level: int, covered: int, entries: int) -> list[Segment]:
        """Writes postings as sorted runs of max_segment_entries, but for the last, each a file of its own; entries: how many there must be.

        Postings beyond one run are numbered by key and ordinal, so that a run's rows are known before it is written, and go to one task
        for each run.
        """
        if not entries:
            return []
        path, cap, order = self._folder(f"index-{index}"), self.options.max_segment_entries, ["key", "ordinal"]
        pieces = -(-entries // cap)
        staged = f"{self.spec.name}/staged/{path.rsplit('/', 1)[1]}-{index}"
        try:
            if pieces == 1:
                dealt = postings.repartition(1).withColumn("piece", F.lit(0)).sortWithinPartitions(*order)
            else:
                numbered, _ = number_rows(postings, order, self._at(staged), name="_n")
                piece = F.floor(F.col("_n") / cap).cast("int")
                dealt = numbered.select(*order, piece.alias("piece")).repartition(pieces, "piece").sortWithinPartitions("piece", *order)
            self._bloomed(dealt.write.partitionBy("piece"), ["key"]).parquet(self._at(path))
        finally:
            self.files.delete(staged)
        written = self.spark.read.schema("key long, ordinal long, piece int").parquet(self._at(path)).groupBy("piece")
        found = sorted(written.agg(F.count("*").alias("n"), F.min("key").alias("a"), F.max("key").alias("b")).collect())
        if sum(r.n for r in found) != entries or len(found) != pieces or any(x.b > y.a for x, y in zip(found, found[1:], strict=False)):
            raise manifests.ManifestError(f"{path}: {sum(r.n for r in found)} postings in {len(found)} runs were written of {entries}, or they aren't in order")
        return [Segment(f"{path}/piece={r.piece}", level, r.n, covered, r.a, r.b) for r in found]

    def misplaced(self, index: str) -> int:
        """Postings of the index's runs that stand before one with a smaller key or ordinal in their file; 0 unless a file was made elsewhere."""
        paths = [self._at(s.path) for s in self.manifest.indexes.get(index, [])]
        if not paths:
            return 0
        rows = self.spark.read.schema(POSTING).parquet(*paths).select("key", "ordinal", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"))
        here = Window.partitionBy("file").orderBy("at")
        after = rows.select(F.struct("key", "ordinal").alias("x"), F.lead(F.struct("key", "ordinal")).over(here).alias("y"))
        return after.where("y < x").count()

    def _replay(self) -> None:
        """Rebuilds postings that an index lacks, from the rows."""
        changed = False
        for name in self.spec.indexes:
            segments = self.manifest.indexes.get(name, [])
            if any(not self.files.exists(s.path) for s in segments):
                self.manifest.indexes[name] = []
            covered = self.manifest.covered(name)
            if covered < self.manifest.committed:
                rows = self.table.where(F.col("ordinal") >= covered)
                self.manifest.indexes.setdefault(name, []).extend(self._write_runs(name, self._postings(rows, name), 0, self.manifest.committed, self.manifest.committed - covered))
                changed = True
        if changed:
            manifests.write(self.files, self.spec.name, self.manifest)

    def postings(self, index: str, value: int | None = None) -> DataFrame:
        """key, ordinal of an index: all runs and the pending rows. With a value, runs whose keys can't hold it aren't read."""
        runs = [s for s in self.manifest.indexes.get(index, []) if value is None or s.min_key <= value <= s.max_key]
        paths = sorted({self._at(s.path) for s in runs})
        frames = [self.spark.read.schema(POSTING).parquet(*paths)] if paths else []
        if self.pending:
            frames.append(self._postings(self.spark.read.parquet(*[self._at(b.path) for b in self.pending]), index))
        return reduce(DataFrame.unionByName, frames) if frames else self.spark.createDataFrame([], POSTING)

    def find(self, index: str, value: int, by_index: bool = False) -> DataFrame:
        """Rows by key, in ordinal order: by a filter pushed into the rows' scan or, by_index, by ordinals from the index."""
        key = self.spec.indexes[index]()
        if not by_index:
            return lookup.find(self.table, key, value)
        return lookup.rows_at(self.table, self.find_ordinals(index, value))

    def find_ordinals(self, index: str, value: int) -> DataFrame:
        return lookup.find_ordinals(self.postings(index, signed(value)), "key", value)

    def count_by(self, index: str, value: int) -> int:
        """From the index alone."""
        return lookup.count_by(self.postings(index, signed(value)), "key", value).first().n

    def read(self, ordinal: int) -> DataFrame:
        return lookup.read_ordinal(self.table, ordinal, self.count)

    def read_range(self, start: int, n: int) -> DataFrame:
        return lookup.read_range(self.table, start, n, self.count)

    def index_statistics(self) -> DataFrame:
        """name, segment_count, pending_count, covered_up_to of each index."""
        waiting = sum(b.rows for b in self.pending)
        rows = [(f"index-{n}", len(self.manifest.indexes.get(n, [])), waiting, self.manifest.covered(n)) for n in self.spec.indexes]
        return self.spark.createDataFrame(rows, "name string, segment_count int, pending_count int, covered_up_to long")

    def _runs(self, index: str) -> list[Run]:
        return [Run(i, s.level, s.entries) for i, s in enumerate(self.manifest.indexes.get(index, []))]

    def planned_maintenance_entries(self) -> int:
        return sum(planned_entries(self._runs(i), self.options.merge_fanout, self.options.max_segment_entries) for i in self.spec.indexes)

    def maintain(self, callback: Callable[[Progress], None] | None = None, done: int = 0, total: int | None = None) -> int:
        """Merges runs until no merge makes progress; returns the entries read. Each merge is a commit of its own."""
        total = self.planned_maintenance_entries() if total is None else total
        for index in self.spec.indexes:
            stage = f"{self.spec.name}/index-{index}"
            while chosen := next_merge(self._runs(index), self.options.merge_fanout, self.options.max_segment_entries):
                segments = self.manifest.indexes[index]
                inputs = [segments[r.age] for r in chosen]
                entries = sum(s.entries for s in inputs)
                postings = self.spark.read.schema(POSTING).parquet(*[self._at(s.path) for s in inputs])
                made = self._write_runs(index, postings, chosen[0].level + 1, max(s.covered_up_to for s in inputs), entries)
                self.manifest.indexes[index] = [s for s in segments if s not in inputs] + made
                manifests.write(self.files, self.spec.name, self.manifest)
                done += entries
                if callback:
                    callback(Progress(stage, done, total))
        return done

    def vacuum(self) -> list[str]:
        """Deletes folders that the manifest doesn't name, and returns them; not while another process reads or writes."""
        live = {b.path for b in self.manifest.batches + self.pending} | {s.path for x in self.manifest.indexes.values() for s in x}
        folders, gone = {p.split("/piece=")[0] for p in live}, []

        def delete(path: str) -> None:
            self.files.delete(path)
            gone.append(path)

        for kind in ["staged", "data", *(f"index-{n}" for n in self.spec.indexes)]:
            for name in self.files.names(f"{self.spec.name}/{kind}"):
                path = f"{self.spec.name}/{kind}/{name}"
                if path not in folders:
                    delete(path)
                elif path not in live:  # some runs of the folder were merged, others stay
                    for piece in self.files.names(path):
                        if piece.startswith("piece=") and f"{path}/{piece}" not in live:
                            delete(f"{path}/{piece}")
        return gone
