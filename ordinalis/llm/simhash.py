"""SimHash near-duplicates: pigeonhole blocks propose, Hamming distance confirms, and linked fingerprints form components.

Two 64-bit fingerprints that differ in at most three bits agree on three of six blocks at least, so they share one of 20 keys of 32 bits
or so. Only distinct fingerprints are keyed: copies of a document cost one row. Inside a key, fingerprints are compared by distance in the
memory of one task and only a spanning forest of the links leaves it, never all pairs. A key with many distinct fingerprints is dealt out
again by the same rule on its other blocks; those groups can't hold more than 2^16 fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import bounded_batches, materialize, packed, small, unpacked

SEED, SHINGLE, DISTANCE = 42, 3, 3
BLOCKS = (11, 11, 11, 11, 10, 10)
#: Distinct fingerprints of a key that one task compares; more are dealt out again.
GROUP = 2048
BIT_TABLE = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def spans(widths: tuple[int, ...], bits: list[int]) -> list[int]:
    """Masks of consecutive groups of the given bit positions."""
    out, at = [], 0
    for w in widths:
        out.append(sum(1 << b for b in bits[at : at + w]))
        at += w
    return out


def key_masks() -> tuple[list[int], list[list[int]]]:
    """The 20 masks of three blocks, and for each the 20 masks that add three of six parts of its other bits."""
    blocks = spans(BLOCKS, list(range(64)))
    first = [sum(c) for c in combinations(blocks, 3)]
    second = []
    for m in first:
        rest = [b for b in range(64) if not m >> b & 1]
        size, over = divmod(len(rest), 6)
        parts = spans(tuple(size + (i < over) for i in range(6)), rest)
        second.append([m | sum(c) for c in combinations(parts, 3)])
    return first, second


def fingerprint(text: str | None, k: int = SHINGLE, seed: int = SEED) -> int:
    import xxhash

    words = (text or "").encode().lower().split()  # bytes: only A-Z, and only the six ASCII white spaces
    if not words:
        return 0
    if len(words) < k:
        shingles: list[bytes] = [b" ".join(words)]
    else:
        shingles = list(map(b" ".join, zip(*(words[i:] for i in range(k)), strict=False)))
    n = len(shingles)
    h = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(seed)), np.uint64, n).astype("<u8").view(np.uint8).reshape(n, 8)
    ones = np.concatenate([np.bincount(h[:, j], minlength=256) @ BIT_TABLE for j in range(8)])
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def simhash(df: DataFrame, text: str = "text", out: str = "fingerprint_bits", k: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """The other columns and the fingerprint, as a signed long, of each whole text. Null texts have no words: fingerprint zero."""
    bounded_batches(df.sparkSession)
    kept = [c for c in df.columns if c not in (text, out)]
    source = df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([signed(fingerprint(x, k, seed)) for x in batch.column(len(kept)).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], found], names=[*batch.schema.names[:-1], out])

    from pyspark.sql import types as T

    return source.mapInArrow(run, T.StructType([*source.schema.fields[:-1], T.StructField(out, T.LongType(), False)]))


def forest(values: np.ndarray, distance: int = DISTANCE) -> list[tuple[int, int]]:
    """Links that join what pairs within the distance join, one fewer than members in each component. values: distinct."""
    left, links = values, []
    while left.size > 1:
        frontier, left = [left[0]], left[1:]
        while frontier and left.size:
            x = frontier.pop()
            near = np.bitwise_count(left ^ x) <= distance
            if near.any():
                new = left[near]
                links += [(x, y) for y in new]
                frontier += list(new)
                left = left[~near]
    return links


def link_groups(df: DataFrame, group: list[str], distance: int = DISTANCE) -> DataFrame:
    """a, b: forest links inside each group of `group` columns. df must be partitioned by them, by an explicit repartition(), and sorted within partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry: tuple[np.ndarray, ...] | None = None

        def links(keys: list[np.ndarray], fps: np.ndarray, last: bool):
            new = np.ones(len(fps), bool)
            new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
            starts = np.flatnonzero(new)
            upto = len(fps) if last else int(starts[-1])
            ends = np.append(starts[1:], len(fps))
            sizes = ends - starts
            whole = ends <= upto
            two = starts[whole & (sizes == 2)]
            two = two[np.bitwise_count(fps[two] ^ fps[two + 1]) <= distance]
            out = [(fps[two], fps[two + 1])]
            more = [p for s, e in zip(starts[whole & (sizes > 2)], ends[whole & (sizes > 2)], strict=True) for p in forest(fps[s:e], distance)]
            if more:
                out.append(tuple(np.array(c, np.uint64) for c in zip(*more, strict=True)))
            a, b = (np.concatenate(c).view(np.int64) for c in zip(*out, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], names=["a", "b"]), tuple(x[upto:] for x in (*keys, fps))

        for batch in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            cols[-1] = cols[-1].view(np.uint64)
            if carry is not None:
                cols = [np.concatenate(x) for x in zip(carry, cols, strict=True)]
            if len(cols[-1]):
                found, carry = links(cols[:-1], cols[-1], False)
                if found.num_rows:
                    yield found
        if carry is not None and len(carry[-1]):
            found, _ = links(list(carry[:-1]), carry[-1], True)
            yield found

    return df.select(*group, "fp").mapInArrow(run, "a long, b long")


def similar_links(distinct: DataFrame) -> DataFrame:
    """a > b: links between distinct fingerprints (column fp) whose components are those of all pairs within the distance."""
    first, second = key_masks()
    keys = F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("key")) for i, m in enumerate(first)])
    parts = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = distinct.select("fp", F.inline(keys))
    # keys are counted, with partial sums, before any fingerprints meet in a task: those of over GROUP, one in GROUP rows at most, are dealt out again
    large = materialize(keyed.groupBy("t", "key").agg(F.count("*").alias("n")).where(F.col("n") > GROUP).select("t", "key"), "large")
    near = link_groups(keyed.join(small(large), ["t", "key"], "left_anti").repartition(parts, "t", "key").sortWithinPartitions("t", "key"), ["t", "key"])
    again = F.element_at(F.array(*[F.array(*[F.lit(signed(m)) for m in ms]) for ms in second]), F.col("t") + 1)
    dealt = keyed.join(small(large), ["t", "key"], "left_semi").select("t", "fp", F.posexplode(again).alias("s", "mask")).select((F.col("t") * 20 + F.col("s")).alias("t"), F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp")
    far = link_groups(dealt.repartition(parts, "t", "key").sortWithinPartitions("t", "key"), ["t", "key"])
    return near.unionByName(far).distinct()


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, text_hash, fingerprint_bits, component_id, one row per row of df.

    Rows are linked if their fingerprints differ in three bits or fewer; component_id is the smallest key that can be reached, itself
    included. Texts without words have fingerprint zero and link like any other. Repeated rows stay; null keys are never a component's
    name unless all its keys are null. Other columns aren't read. An empty table gives an empty result.
    """
    source = df.select(F.col(f"`{key}`").alias("key"), F.xxhash64(f"`{text}`").alias("text_hash"), F.col(f"`{text}`").alias("text"))
    signatures = materialize(simhash(source), "simhash")
    distinct = materialize(signatures.groupBy(F.col("fingerprint_bits").alias("fp")).agg(F.min("key").alias("least")), "fingerprints")
    roots = components(materialize(similar_links(distinct), "links"))
    named = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    by_print = named.join(least, "root").select("fp", "root", "component_id")
    return signatures.join(by_print, signatures.fingerprint_bits == by_print.fp, "left").select(F.col("key").alias(key), "text_hash", "fingerprint_bits", "component_id", "root")


def deduplicate(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component, with all its columns: the one with the smallest key; of equal keys, that with the smallest text hash, once.

    Null keys come last, so such a row stays only if its component has no other.
    """
    groups = near_duplicates(df, key, text)
    rank = F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("k"), F.col("text_hash").alias("h"))
    stay = groups.groupBy("root").agg(F.min(rank).alias("r")).select("r.k", "r.h")
    rows = packed(df, key=F.col(f"`{key}`"), hash=F.xxhash64(f"`{text}`"))
    kept = rows.join(stay, F.col("key").eqNullSafe(F.col("k")) & (F.col("hash") == F.col("h")), "left_semi")
    return kept.dropDuplicates(["key", "hash"]).select(*unpacked(df.columns))


def op7(df: DataFrame) -> DataFrame:
    found = near_duplicates(df)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fingerprint_bits")), 16, "0").alias("fingerprint"), "component_id")
