"""SentencePiece encoding and decoding by distinct chunks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import chunks
from .shared import bounded_batches


def piece_encode_decode(df: DataFrame, model_path: str, text: str = "text", ids: str = "piece_ids", decoded: str = "decoded") -> DataFrame:
    """Adds the ids of each whole text, with begin and end ids, as little-endian unsigned 32-bit integers, and the text that the model decodes from them.

    Each marked word is segmented once per worker and its ids are joined by position; a model with pieces across markers is encoded
    text by text. A null text counts as empty: begin and end ids only, decoded to an empty text. Other columns stay as they are, rows
    are never dropped or merged; columns of the new names are replaced. No shuffle; memory is one batch and a bounded table.
    """
    bounded_batches(df.sparkSession)
    kept = [c for c in df.columns if c not in (ids, decoded)]
    source = df.select(*[F.col(f"`{c}`") for c in kept])
    schema = T.StructType([*source.schema.fields, T.StructField(ids, T.BinaryType(), False), T.StructField(decoded, T.StringType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        model = chunks.piece_model(model_path)
        whole = chunks.crosses_marker(model_path)
        table = None if whole else chunks.pieces(model_path)
        encode = table or (lambda texts: [np.asarray(x, "<u4").tobytes() for x in model.encode(texts, num_threads=1)])
        begin, end = (np.asarray([x], "<u4").tobytes() for x in (model.bos_id(), model.eos_id()))
        for batch in batches:
            texts = [x or "" for x in batch.column(kept.index(text)).to_pylist()]
            found = [begin + x + end for x in encode(texts)]
            back = [model.decode(np.frombuffer(x, "<u4").tolist()) for x in found]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.binary()), pa.array(back, pa.string())], names=[*batch.schema.names, ids, decoded])
        if table:
            table.rest()

    return source.mapInArrow(run, schema)


def op6(df: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document."""
    out = piece_encode_decode(df.select("doc_id", "text"), model_path)
    return out.select("doc_id", (F.octet_length("piece_ids") / 4).cast("long").alias("n_tokens"), F.sha2("piece_ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
