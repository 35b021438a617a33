"""Removal of byte strings that repeat anywhere in the corpus, by a depth-limited radix sort of suffixes.

Suffixes are ordered only through WINDOW bytes, most significant digits first, and only as far as they stay in groups of two or more:

1. The first digit of a suffix is the least 32-byte gram, by hash, inside its first WINDOW bytes, and where it stands. Equal windows have
   equal grams at equal places, so suffixes with one digit form a cell around the gram: a run of neighbouring suffixes
   that one row stands for. About one gram in 70 leads a cell. Grams that occur once are done.
2. The next digit is the whole cell. Equal cells are repeated in all their suffixes; of a group of equal cells one goes on.
3. Cells that share the gram but differ go on to the last digit: their suffixes are ordered through all WINDOW bytes. Groups of two
   or more are exactly the repeated windows.

Grams, cells and windows are compared by 64-bit hashes within a gram's group, on top of the gram's own 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import bounded_batches, materialize

WINDOW, GRAM = 200, 32
#: Bytes whose grams are found at once; places in them take 20 bits of a packed key.
PIECE, PLACE_BITS = 1 << 18, 20
#: Different cells of one gram whose windows one task holds, of at most 169 windows of eight bytes each; those of larger groups are dealt out one by one.
GROUP_CELLS = 1 << 13
#: Cells whose windows are hashed at once.
CELLS_AT_ONCE = 1 << 12


def mixed(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Of the 32 bytes from each place; data: bytes."""
    x = data.astype(np.uint64)
    for step in (1, 2, 4):
        x = x[:-step] | x[step:] << np.uint64(8 * step)
    x = mixed(x)
    x = mixed(x[:-8] * np.uint64(3) + x[8:])
    return mixed(x[:-16] * np.uint64(5) + x[16:])


def lead_cells(data: bytes, bounds: list[tuple[int, int]]) -> tuple[np.ndarray, ...]:
    """gram hash, its place, first and last window start of every cell; windows stay inside bounds. data: under 2^20 bytes."""
    if len(data) < WINDOW:
        return tuple(np.zeros(0, t) for t in (np.uint64, np.int64, np.int64, np.int64))
    grams = gram_hashes(np.frombuffer(data, np.uint8))
    low = np.uint64((1 << PLACE_BITS) - 1)
    least, span, width = grams & ~low | np.arange(len(grams), dtype=np.uint64), 1, WINDOW - GRAM + 1
    while 2 * span <= width:
        least, span = np.minimum(least[:-span], least[span:]), 2 * span
    rest = width - span
    least = np.minimum(least[: len(least) - rest], least[rest:])
    place = (least & low).astype(np.int64)
    inside = np.zeros(len(place), bool)
    for a, b in bounds:
        if b - a >= WINDOW:
            inside[a : b - WINDOW + 1] = True
    place[~inside] = -1
    first = np.flatnonzero(np.diff(place, prepend=-2))
    last = np.append(first[1:], len(place)) - 1
    kept = place[first] >= 0
    first, last = first[kept], last[kept]
    return grams[place[first]], place[first], first, last


def cells(docs: DataFrame) -> DataFrame:
    """key, text_hash, gram, cell, first, last of every cell of docs (key, text_hash, text); first and last are window starts in UTF-8 bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        def found(pieces: list[tuple[object, int, int, bytes]]) -> pa.RecordBatch:
            data, bounds, at = b"".join(p[3] for p in pieces), [], 0
            for p in pieces:
                bounds.append((at, at + len(p[3])))
                at += len(p[3])
            gram, place, first, last = lead_cells(data, bounds)
            starts = np.array([b[0] for b in bounds], np.int64)
            owner = np.searchsorted(starts, first, "right") - 1
            content = [xxhash.xxh3_64_intdigest(data[a : b + WINDOW], seed=c - a) for a, b, c in zip(first.tolist(), last.tolist(), place.tolist(), strict=True)]
            shift = np.array([p[2] for p in pieces], np.int64) - starts
            keys = pa.array([p[0] for p in pieces], pa.int64()).take(pa.array(owner))
            hashes = np.array([p[1] for p in pieces], np.int64)[owner]
            return pa.RecordBatch.from_arrays([keys, pa.array(hashes), pa.array(gram.view(np.int64)), pa.array(np.array(content, np.uint64).view(np.int64)), pa.array(first + shift[owner]), pa.array(last + shift[owner])], names=["key", "text_hash", "gram", "cell", "first", "last"])

        held: list[tuple[object, int, int, bytes]] = []
        size = 0
        for batch in batches:
            for key, text_hash, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = (text or "").encode()
                for at in range(0, max(1, len(data) - WINDOW + 1), PIECE):  # pieces of a long text share all but one byte of a window
                    piece = data[at : at + PIECE + WINDOW - 1]
                    if len(piece) >= WINDOW:
                        held.append((key, text_hash, at, piece))
                        size += len(piece)
                    if size >= PIECE:
                        yield found(held)
                        held, size = [], 0
        if held:
            yield found(held)

    return docs.select("key", "text_hash", "text").mapInArrow(run, "key long, text_hash long, gram long, cell long, first long, last long")


def same_row(a: str, b: str) -> Column:
    return F.col(f"{a}.key").eqNullSafe(F.col(f"{b}.key")) & (F.col(f"{a}.text_hash") == F.col(f"{b}.text_hash"))


def cell_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The bytes of chosen cells (gram, n, key, text_hash, first, last), with the gram's place left to be the same in equal windows."""
    lists = wanted.groupBy("key", "text_hash").agg(F.collect_list(F.struct("gram", "n", "first", "last")).alias("cells"))
    met = docs.alias("d").join(lists.alias("w"), same_row("d", "w")).select("d.key", "d.text_hash", "text", "cells")
    schema = pa.schema([("gram", pa.int64()), ("n", pa.int64()), ("key", pa.int64()), ("text_hash", pa.int64()), ("first", pa.int64()), ("data", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text_hash, text, wanted in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = (text or "").encode()
                rows = [(c["gram"], c["n"], key, text_hash, c["first"], data[c["first"] : c["last"] + WINDOW]) for c in wanted]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return met.mapInArrow(run, "gram long, n long, key long, text_hash long, first long, data binary")


def window_hashes(gram: int, data: bytes) -> np.ndarray:
    import xxhash

    n = len(data) - WINDOW + 1
    return np.fromiter((xxhash.xxh3_64_intdigest(data[i : i + WINDOW], seed=gram) for i in range(n)), np.uint64, n)


def spans_of(rows: list[tuple], repeated: np.ndarray, sizes: list[int]) -> list[tuple]:
    """(key, text_hash, start, end) of the runs of repeated windows in each row's cell."""
    out, at = [], 0
    for (_, n, key, text_hash, first, _), size in zip(rows, sizes, strict=True):
        if n == 1:
            flags = np.diff(repeated[at : at + size].astype(np.int8), prepend=0, append=0)
            out += [(key, text_hash, first + a, first + b - 1 + WINDOW) for a, b in zip(np.flatnonzero(flags == 1).tolist(), np.flatnonzero(flags == -1).tolist(), strict=True)]
        at += size
    return out


SPANS = pa.schema([("key", pa.int64()), ("text_hash", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])


def order_windows(texts: DataFrame) -> DataFrame:
    """Spans of repeated windows of cells that occur once; texts are partitioned by gram and sorted, so that a group is read in one run.

    A task holds the groups of CELLS_AT_ONCE cells or one group, of GROUP_CELLS cells at most: some 20 MB.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(rows: list[tuple]) -> pa.RecordBatch:
            lists = [window_hashes(r[0] & 0xFFFFFFFFFFFFFFFF, r[5]) for r in rows]
            sizes = [len(x) for x in lists]
            hashes = np.concatenate(lists)
            # a window twice in one cell is two windows as well
            weight = np.repeat(np.array([min(r[1], 2) for r in rows], np.int64), sizes)
            _, place = np.unique(hashes, return_inverse=True)
            repeated = np.bincount(place, weights=weight)[place] >= 2
            spans = spans_of(rows, repeated, sizes)
            return pa.RecordBatch.from_arrays([pa.array([s[i] for s in spans], pa.int64()) for i in range(4)], schema=SPANS)

        rows: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if len(rows) >= CELLS_AT_ONCE and row[0] != rows[-1][0]:
                    yield found(rows)
                    rows = []
                rows.append(row)
        if rows:
            yield found(rows)

    return texts.mapInArrow(run, "key long, text_hash long, start long, end long")


def deal_windows(texts: DataFrame) -> DataFrame:
    """As order_windows, for groups of any size: a row for every window, counted by its hash with partial sums before the shuffle.

    Windows are hashed once to be counted and once to be met, from the same shuffled texts, so that they need no table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for gram, n, key, text_hash, first, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                hashes = window_hashes(gram & 0xFFFFFFFFFFFFFFFF, data).view(np.int64)
                same = lambda x, m=len(hashes): pa.array([x] * m, pa.int64())
                yield pa.RecordBatch.from_arrays([same(gram), pa.array(hashes), same(min(n, 2)), same(key), same(text_hash), pa.array(first + np.arange(len(hashes)))], names=["gram", "window", "n", "key", "text_hash", "start"])

    windows = texts.mapInArrow(run, "gram long, window long, n long, key long, text_hash long, start long")
    twice = windows.groupBy("gram", "window").agg(F.sum("n").alias("m")).where("m > 1").select("gram", "window")
    return windows.where("n = 1").join(twice, ["gram", "window"]).select("key", "text_hash", "start", (F.col("start") + WINDOW).alias("end"))


def repeated_spans(docs: DataFrame, group_cells: int = GROUP_CELLS) -> DataFrame:
    """key, text_hash, start, end: byte ranges, in no order and with overlaps, whose union is what repeated windows cover."""
    found = cells(docs)
    grams = found.groupBy("gram").agg(F.count("*").alias("n"), F.min("cell").alias("a"), F.max("cell").alias("b")).where("n > 1")
    grams = materialize(grams.select("gram", (F.col("a") == F.col("b")).alias("alike")), "grams")
    met = materialize(found.join(grams, "gram"), "cells")
    whole = ["key", "text_hash", F.col("first").alias("start"), (F.col("last") + WINDOW).alias("end")]
    rest = met.where(~F.col("alike"))
    kinds = rest.groupBy("gram", "cell").agg(F.count("*").alias("n"), F.min(F.struct("key", "text_hash", "first", "last")).alias("r"))
    kinds = materialize(kinds.select("gram", "cell", "n", "r.*"), "kinds")
    twice = rest.join(kinds.where("n > 1").select("gram", "cell"), ["gram", "cell"])
    large = materialize(kinds.groupBy("gram").agg(F.count("*").alias("m")).where(F.col("m") > group_cells).select("gram"), "large")
    many = not large.isEmpty()
    few = kinds.join(large, "gram", "left_anti") if many else kinds
    # no table of these texts: whoever reads docs by row, the caller included, does so in one plan, where they are shuffled once
    texts = cell_texts(docs, few.drop("cell")).repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "gram")
    last = order_windows(texts.sortWithinPartitions("gram"))
    if many:
        last = last.unionByName(deal_windows(cell_texts(docs, kinds.join(large, "gram", "left_semi").drop("cell"))))
    return met.where("alike").select(*whole).unionByName(twice.select(*whole)).unionByName(last)


def remove_repeats(df: DataFrame, key: str = "doc_id", text: str = "text", group_cells: int = GROUP_CELLS) -> DataFrame:
    """key, n_bytes, n_removed, removed (array of maximal byte ranges, in order), kept (binary: the other bytes), one row per row of df.

    Bytes covered by a string of WINDOW bytes that also starts anywhere else in the table, this text included, are removed; all strings
    are judged on the input. Matches don't cross texts. Null texts count as empty; texts shorter than WINDOW stay whole. Rows are told
    apart by key and text, and rows with both alike repeat each other; null keys are keys like others. The key must be a long. Other
    columns aren't read. An empty table gives an empty result.
    """
    bounded_batches(df.sparkSession)
    docs = df.select(F.col(f"`{key}`").cast("long").alias("key"), F.xxhash64(f"`{text}`").alias("text_hash"), F.col(f"`{text}`").alias("text"))
    spans = repeated_spans(docs, group_cells).groupBy("key", "text_hash").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    joined = docs.alias("d").join(spans.alias("s"), same_row("d", "s"), "left").select("d.key", "text", F.col("spans.start").alias("starts"), F.col("spans.end").alias("ends"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = []
                for k, text, starts, ends in zip(*(c.to_pylist() for c in batch.slice(at, 256).columns), strict=True):
                    data, runs = (text or "").encode(), []
                    for a, b in sorted(zip(starts or [], ends or [], strict=True)):
                        if runs and a <= runs[-1][1]:
                            runs[-1][1] = max(b, runs[-1][1])
                        else:
                            runs.append([a, b])
                    edges = [0, *(x for r in runs for x in r), len(data)]
                    kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                    rows.append((k, len(data), len(data) - len(kept), [{"start": a, "end": b} for a, b in runs], kept))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["key", "n_bytes", "n_removed", "removed", "kept"])

    types = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary()]
    return joined.mapInArrow(run, "key long, n_bytes long, n_removed long, removed array<struct<start:long,end:long>>, kept binary").withColumnRenamed("key", key)


def op2(df: DataFrame) -> DataFrame:
    return remove_repeats(df).select("doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
