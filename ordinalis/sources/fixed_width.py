"""Import and export of fixed-width record files: consecutive little-endian records, files of as many whole records as fit a segment."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import ADDRESS_LENGTH

TRANSACTION_BYTES, ADDRESS_BYTES = 40, 8 + ADDRESS_LENGTH


def decode_transactions(data: bytes) -> np.ndarray:
    """(records, 5) longs; a torn record at the end is left out."""
    return np.frombuffer(data[: len(data) // TRANSACTION_BYTES * TRANSACTION_BYTES], "<i8").reshape(-1, 5)


def encode_transactions(rows: np.ndarray) -> bytes:
    return np.ascontiguousarray(rows, "<i8").tobytes()


def decode_addresses(data: bytes) -> list[tuple[int, str]]:
    n = len(data) // ADDRESS_BYTES
    records = np.frombuffer(data[: n * ADDRESS_BYTES], np.dtype([("id", "<i8"), ("address", f"S{ADDRESS_LENGTH}")]))
    return [(int(i), a.decode("ascii")) for i, a in zip(records["id"], records["address"], strict=True)]


def encode_addresses(rows: list[tuple[int, str]]) -> bytes:
    return np.array([(i, a.encode("ascii")) for i, a in rows], np.dtype([("id", "<i8"), ("address", f"S{ADDRESS_LENGTH}")])).tobytes()


class RecordFilesError(ValueError):
    pass


def check_files(files: DataFrame, width: int, capacity: int) -> int | None:
    """The number of the last file, None without files. files: no, length. A file that is missing, too large, or short and not the last is an error."""
    last = files.agg(F.max("no")).first()[0]
    if last is None:
        return None
    no, size, whole = F.col("no"), F.col("length"), capacity // width * width
    n, large, short = files.agg(F.count_distinct("no"), F.min(F.when(size > capacity, no)), F.min(F.when((no < last) & (size < whole), no))).first()
    for wrong, what in ((large, "is larger than a segment"), (short, "is short but not the last")):
        if wrong is not None:
            raise RecordFilesError(f"data{wrong:06d}.dat {what}")
    if n != last + 1:
        raise RecordFilesError(f"{n} files are there of {last + 1}")
    return last


def read_records(spark: SparkSession, folder: str, kind: str, segment_size: int) -> DataFrame:
    """The records of data%06d.dat files with their ordinals; kind: transactions or addresses. A task holds one file of up to a segment.

    A file's number gives its first ordinal, so files are read independently. Bytes after the last whole record are dropped in the last
    file, as torn; other files must be full.
    """
    width = TRANSACTION_BYTES if kind == "transactions" else ADDRESS_BYTES
    per_file = segment_size // width
    number = F.regexp_extract("path", r"data(\d+)\.dat$", 1).cast("long")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "data*.dat").load(folder).withColumn("no", number)
    check_files(files.select("no", "length"), width, segment_size)
    schema = "ordinal long, v0 long, v1 long, v2 long, v3 long, v4 long" if kind == "transactions" else "ordinal long, id long, address string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for no, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                first = no * per_file
                if kind == "transactions":
                    rows = decode_transactions(data)
                    columns = [pa.array(first + np.arange(len(rows))), *(pa.array(np.ascontiguousarray(rows[:, i])) for i in range(5))]
                    names = ["ordinal", "v0", "v1", "v2", "v3", "v4"]
                else:
                    found = decode_addresses(data)
                    columns = [pa.array(first + np.arange(len(found))), pa.array([r[0] for r in found], pa.int64()), pa.array([r[1] for r in found], pa.string())]
                    names = ["ordinal", "id", "address"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return files.select("no", "content").mapInArrow(run, schema)


def file_contents(table: DataFrame, kind: str, segment_size: int) -> DataFrame:
    """name, content of the fixed-width files that hold a table with ordinals: a row and a task for each file, as bytes to write anywhere."""
    width = TRANSACTION_BYTES if kind == "transactions" else ADDRESS_BYTES
    numbered = table.withColumn("file", F.floor(F.col("ordinal") / (segment_size // width)))
    fields = ["v0", "v1", "v2", "v3", "v4"] if kind == "transactions" else ["id", "address"]

    def run(key, rows):
        import pandas as pd

        rows = rows.sort_values("ordinal")
        data = encode_transactions(rows[fields].to_numpy(np.int64)) if kind == "transactions" else encode_addresses(list(rows[fields].itertuples(index=False, name=None)))
        return pd.DataFrame({"name": [f"data{int(key[0]):06d}.dat"], "content": [data]})

    return numbered.select("file", "ordinal", *fields).groupBy("file").applyInPandas(run, "name string, content binary")


def write_records(table: DataFrame, kind: str, segment_size: int, folder: str) -> int:
    """Writes file_contents() as files that read_records() takes and returns how many. A file is written under another name and then moved, so
    lost executors leave none half written. The folder must be one that all executors can write through pyarrow.fs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(folder)
        system.create_dir(base, recursive=True)
        for batch in batches:
            names = batch.column(0).to_pylist()
            for name, data in zip(names, batch.column(1), strict=True):
                other = f"{base}/.{name}.{uuid.uuid4().hex}"
                with system.open_output_stream(other) as out:
                    out.write(data.as_buffer())
                system.move(other, f"{base}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string())], names=["name"])

    return file_contents(table, kind, segment_size).mapInArrow(run, "name string").count()
