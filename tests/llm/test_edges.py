"""Every operator on tables that are empty, or hold nulls, empty and long texts, ties, repeated rows and columns with clashing names."""

import pytest
from cases import documents, frame, rows_of

from ordinalis.llm import decontamination, entry, licenses, maxent, piece_codec, quality, repeats, secrets, simhash, sorted_tables, token_counts

BYTE, PIECE = entry.tokenizer_file(entry.BYTE_BPE), entry.tokenizer_file(entry.PIECE_BPE)


def op9(spark, df):
    items = spark.createDataFrame([(1, df.sparkSession.createDataFrame([("x",)], "a string").first().a + " two three"), (2, None), (None, "one two"), (3, ""), (4, "one two")], "item_id long, text string")
    return decontamination.op9(df, items)


OPERATORS = {
    "op1": lambda s, df: licenses.op1(df),
    "op2": lambda s, df: repeats.op2(df),
    "op3": lambda s, df: token_counts.op3(df, BYTE),
    "op4": lambda s, df: quality.op4(df),
    "op5": lambda s, df: sorted_tables.op5(s, df, BYTE),
    "op6": lambda s, df: piece_codec.op6(df, PIECE),
    "op7": lambda s, df: simhash.op7(df),
    "op8": lambda s, df: secrets.op8(df),
    "op9": op9,
    "op10": lambda s, df: maxent.op10(df),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](spark, frame(spark, [])).collect() == []


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows_and_clashing_columns(spark, name):
    rows = documents()
    plain = OPERATORS[name](spark, frame(spark, rows))
    found = rows_of(plain)
    assert found == rows_of(OPERATORS[name](spark, frame(spark, rows, clash=True)).select(*plain.columns))
    if name not in ("op1", "op3"):
        assert sorted((r[plain.columns.index("doc_id")] for r in found), key=repr) == sorted((r[0] for r in rows), key=repr)


@pytest.mark.parametrize("make", [lambda s, df: quality.quality(df), lambda s, df: quality.passing(df), lambda s, df: simhash.deduplicate(df), lambda s, df: secrets.redact(df, secrets.secret_spans(df)), lambda s, df: piece_codec.piece_encode_decode(df, PIECE)])
def test_operators_that_keep_columns(spark, make):
    assert make(spark, frame(spark, [])).count() == 0
    df = frame(spark, documents(), clash=True)
    out = make(spark, df)
    assert set(df.columns) <= set(out.columns) and out.count() > 0
    assert out.first()["owner"] == "clash owner"
