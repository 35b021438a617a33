"""Token ids in sorted-string-table shards.

A shard holds documents in ascending key order, as

    data blocks | index | Bloom filter | footer

A data block is a zstandard frame over entries and a list of restarts. An entry is varint(shared key bytes) varint(other key bytes)
varint(value bytes) other-key value; every RESTART-th entry shares nothing, so that a search inside a block can jump between restarts.
The index has one row per block: first key, offset, size, documents and tokens before it. Numbers are little-endian.
A key is the document id as eight bytes, big-endian with the sign bit flipped, which sorts as the numbers do; a null id has the empty key
and comes first. Values are ids of `width` bytes. Repeated ids are neighbours, and a search returns all of them.
"""

from __future__ import annotations

import bisect
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import chunks
from .shared import bounded_batches, fresh_path, materialize

MAGIC = b"ORDSST1\n"
FOOTER = struct.Struct("<QQQQQQII8s")
INDEX_ROW = struct.Struct("<HQIQQ")
RESTART, BLOCK_BYTES, SHARD_BYTES = 16, 1 << 16, 64 << 20
BLOOM_BITS, BLOOM_HASHES = 10, 7
MANIFEST = "part long, seq long, path string, n_docs long, n_tokens long"


def key_of(doc_id: int | None) -> bytes:
    return b"" if doc_id is None else struct.pack(">Q", (doc_id + (1 << 63)) & ((1 << 64) - 1))


def id_of(key: bytes) -> int | None:
    return None if not key else struct.unpack(">Q", key)[0] - (1 << 63)


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def bloom_places(key: bytes, bits: int) -> list[int]:
    import xxhash

    h = xxhash.xxh3_128_intdigest(key)
    a, b = h & 0xFFFFFFFFFFFFFFFF, h >> 64 | 1
    return [(a + i * b) % bits for i in range(BLOOM_HASHES)]


class ShardWriter:
    """Writes one shard to a binary stream; memory is one block, the index and the keys' Bloom places."""

    def __init__(self, out, width: int):
        import zstandard

        self.out, self.width, self.zstd = out, width, zstandard.ZstdCompressor(level=1)
        self.offset = self.n_docs = self.n_tokens = 0
        self.index: list[tuple[bytes, int, int, int, int]] = []
        self.hashes: list[bytes] = []
        self.begin()

    def begin(self) -> None:
        self.block, self.restarts, self.entries, self.first, self.last = bytearray(), [], 0, b"", b""
        self.before = (self.n_docs, self.n_tokens)

    def add(self, key: bytes, value: bytes) -> None:
        shared = 0
        if self.entries % RESTART == 0:
            self.restarts.append(len(self.block))
        else:
            while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
                shared += 1
        if not self.entries:
            self.first = key
        self.block += varint(shared) + varint(len(key) - shared) + varint(len(value)) + key[shared:] + value
        self.last = key
        self.entries += 1
        self.n_docs += 1
        self.n_tokens += len(value) // self.width
        self.hashes.append(key)
        if len(self.block) >= BLOCK_BYTES:
            self.end_block()

    def end_block(self) -> None:
        if self.entries:
            raw = bytes(self.block) + struct.pack(f"<{len(self.restarts)}I", *self.restarts) + struct.pack("<I", len(self.restarts))
            data = self.zstd.compress(raw)
            data += struct.pack("<I", zlib.crc32(data))
            self.out.write(data)
            self.index.append((self.first, self.offset, len(data), *self.before))
            self.offset += len(data)
        self.begin()

    def finish(self) -> None:
        self.end_block()
        index = b"".join(INDEX_ROW.pack(len(k), *rest) + k for k, *rest in self.index)
        bits = max(64, BLOOM_BITS * len(self.hashes) + 7 & ~7)
        bloom = np.zeros(bits, np.uint8)
        for key in self.hashes:
            bloom[bloom_places(key, bits)] = 1
        packed = np.packbits(bloom, bitorder="little").tobytes()
        self.out.write(index + packed + FOOTER.pack(self.offset, len(index), self.offset + len(index), len(packed), self.n_docs, self.n_tokens, self.width, 0, MAGIC))


class ShardReader:
    """Reads a shard from a seekable file: by key, with the Bloom filter and a binary search, or from its start."""

    def __init__(self, file, size: int):
        import zstandard

        self.file, self.zstd = file, zstandard.ZstdDecompressor()
        index_at, index_len, bloom_at, bloom_len, self.n_docs, self.n_tokens, self.width, _, magic = FOOTER.unpack(self.read(size - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a sorted table shard")
        self.bloom, index, at = self.read(bloom_at, bloom_len), self.read(index_at, index_len), 0
        self.blocks: list[tuple[bytes, int, int, int, int]] = []
        while at < len(index):
            length, *rest = INDEX_ROW.unpack_from(index, at)
            at += INDEX_ROW.size
            self.blocks.append((index[at : at + length], *rest))
            at += length
        self.firsts = [b[0] for b in self.blocks]

    def read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def raw(self, k: int) -> tuple[bytes, list[int]]:
        data = self.read(self.blocks[k][1], self.blocks[k][2])
        if zlib.crc32(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
            raise ValueError("a block of a sorted table shard is damaged")
        raw = self.zstd.decompress(data[:-4])
        n = struct.unpack("<I", raw[-4:])[0]
        end = len(raw) - 4 - 4 * n
        return raw[:end], list(struct.unpack(f"<{n}I", raw[end:-4]))

    def entries(self, raw: bytes, at: int = 0) -> Iterator[tuple[bytes, bytes]]:
        key = b""
        while at < len(raw):
            shared, at = read_varint(raw, at)
            rest, at = read_varint(raw, at)
            size, at = read_varint(raw, at)
            key = key[:shared] + raw[at : at + rest]
            yield key, raw[at + rest : at + rest + size]
            at += rest + size

    def scan(self) -> Iterator[tuple[bytes, int, bytes]]:
        """Key, tokens before it in this shard, value."""
        for k, (_, _, _, _, tokens) in enumerate(self.blocks):
            for key, value in self.entries(self.raw(k)[0]):
                yield key, tokens, value
                tokens += len(value) // self.width

    def get(self, key: bytes) -> list[bytes]:
        """All values of a key."""
        bits = 8 * len(self.bloom)
        if not self.blocks or any(not self.bloom[p >> 3] >> (p & 7) & 1 for p in bloom_places(key, bits)):
            return []
        found: list[bytes] = []
        for k in range(max(0, bisect.bisect_left(self.firsts, key) - 1), len(self.blocks)):
            if self.firsts[k] > key:
                break
            raw, restarts = self.raw(k)
            starts = [next(self.entries(raw, at))[0] for at in restarts]
            at = restarts[max(0, bisect.bisect_left(starts, key) - 1)]
            for other, value in self.entries(raw, at):
                if other > key:
                    break
                if other == key:
                    found.append(value)
        return found

    def ids(self, value: bytes) -> bytes:
        return np.frombuffer(value, f"<u{self.width}").astype("<u4").tobytes()


def open_shard(path: str) -> ShardReader:
    from pyarrow import fs

    system, local = fs.FileSystem.from_uri(path)
    return ShardReader(system.open_input_file(local), system.get_file_info(local).size)


def write_token_tables(df: DataFrame, tokenizer_path: str, folder: str, end_id: int, key: str = "doc_id", text: str = "text", vocabulary: int = 50_257) -> DataFrame:
    """Encodes each whole text, appends end_id and writes shards under folder in ascending key order; returns their manifest.

    The manifest has part, seq, path, n_docs and n_tokens, and is itself a table in the shared folder. Null texts count as empty. Rows with
    one id are ordered by a hash of their text, so that shards are the same if a task runs again; rows with the same id and text are
    alike. Texts, not ids, are dealt out by ranges of the id, as the sampling of ranges would otherwise encode everything twice. A
    shard is written under a name of its attempt and then moved, so lost executors leave no half shard. An empty table makes no shard.
    The folder must be one that all executors can write through pyarrow.fs.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    width = 2 if max(vocabulary - 1, end_id) < 1 << 16 else 4
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    source = df.select(F.col(f"`{key}`").cast("long").alias("key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    order = [F.col("key").asc_nulls_first(), F.xxhash64("text")]
    dealt = source.repartitionByRange(parts, *order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        context = TaskContext.get()
        part, attempt = context.partitionId(), context.taskAttemptId()
        system, base = fs.FileSystem.from_uri(folder)
        system.create_dir(base, recursive=True)
        encode, end, seq, rows, writer = chunks.byte_bpe(tokenizer_path), np.asarray([end_id], f"<u{width}").tobytes(), 0, [], None

        def close() -> None:
            nonlocal writer, seq
            writer.finish()
            writer.out.close()
            name = f"{base}/part-{part:06d}-{seq:05d}.sst"
            system.move(f"{base}/.{part}-{seq}-{attempt}", name)
            rows.append((part, seq, f"{folder}/part-{part:06d}-{seq:05d}.sst", writer.n_docs, writer.n_tokens))
            writer, seq = None, seq + 1

        for batch in batches:
            for k, found in zip(batch.column(0).to_pylist(), encode.column(batch.column(1)), strict=True):
                if writer is None:
                    writer = ShardWriter(system.open_output_stream(f"{base}/.{part}-{seq}-{attempt}"), width)
                writer.add(key_of(k), (found if width == 4 else np.frombuffer(found, "<u4").astype("<u2").tobytes()) + end)
                if writer.offset >= SHARD_BYTES:
                    close()
        if writer is not None:
            close()
        encode.rest(chunks.TABLE_ENTRIES)
        yield pa.RecordBatch.from_pylist([dict(zip(("part", "seq", "path", "n_docs", "n_tokens"), r, strict=True)) for r in rows], schema=pa.schema([("part", pa.int64()), ("seq", pa.int64()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

    return materialize(dealt.mapInArrow(run, MANIFEST), "manifest")


def read_token_tables(manifest: DataFrame) -> DataFrame:
    """doc_id, start (tokens of all documents before it), n_tokens, ids (little-endian unsigned 32-bit integers), read from the shards.

    The running total over shards is a window over the manifest, one row per shard of up to 64 MB; shards are read independently.
    """
    spark = manifest.sparkSession
    bounded_batches(spark)
    before = F.sum("n_tokens").over(Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1))
    shards = manifest.select("path", F.coalesce(before, F.lit(0)).alias("base")).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                shard, rows, held = open_shard(path), [], 0
                for key, tokens, value in shard.scan():
                    rows.append((id_of(key), base + tokens, len(value) // shard.width, shard.ids(value)))
                    held += len(rows[-1][3]) + 64
                    if held > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return shards.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def find_documents(manifest: DataFrame, doc_ids: list[int | None]) -> DataFrame:
    """doc_id, ids of every stored document with one of the given ids: each shard is asked through its Bloom filter and a binary search."""
    asked = sorted({key_of(x) for x in doc_ids})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                shard = open_shard(path)
                found = [(id_of(k), shard.ids(v)) for k in asked for v in shard.get(k)]
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.binary())], names=["doc_id", "ids"])

    return manifest.select("path").mapInArrow(run, "doc_id long, ids binary")


def op5(spark: SparkSession, df: DataFrame, tokenizer_path: str) -> DataFrame:
    manifest = write_token_tables(df, tokenizer_path, fresh_path(spark, "sst"), end_id=2)
    return read_token_tables(manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
