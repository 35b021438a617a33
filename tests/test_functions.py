"""Scalar functions: golden values, errors, and random inputs against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from ordinalis.functions import codecs, generators
from ordinalis.model import signed

TEXT = "mzG1qM2WIHQbbYkTKlf1Ejud9UyA3rwBGBmZYW0J1vc4jCvV0m9G6Sd4u2Hm8FBQk"


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def test_hex(spark):
    values = {0: "0", 255: "ff", 2**64 - 1: "f" * 16, 2**63: "8" + "0" * 15}
    for v, text in values.items():
        x = F.lit(signed(v))
        assert one(spark, codecs.to_hex(x)) == text.zfill(16) and one(spark, codecs.to_hex(x, padded=False)) == text
        assert int(one(spark, codecs.unsigned(x))) == v


def test_hex_parser(spark):
    good = {"ff": 255, "FF": 255, "0xff": 255, "0XFF": 255, "00000000000000ff": 255, "f" * 16: -1}
    bad = ["", "0x", "g", "12g4", " ff", "ff ", "-1", "10000000000000000", "ff\n"]
    df = spark.createDataFrame([(t,) for t in [*good, *bad, None]], "s string")
    assert [r[0] for r in df.select(codecs.try_parse_hex(F.col("s"))).collect()] == [*good.values(), *[None] * (len(bad) + 1)]
    assert one(spark, codecs.parse_hex(F.lit("0xff"))) == 255 and one(spark, codecs.parse_hex(F.lit(None).cast("string"))) is None
    with pytest.raises(Exception, match="hexadecimal"):
        one(spark, codecs.parse_hex(F.lit("12g4")))


def test_tolerant_hex(spark):
    assert one(spark, codecs.from_hex(F.lit(" 00000000000000000ff "))) == 255 and one(spark, codecs.from_hex(F.lit("0xff"))) == 255
    assert one(spark, codecs.tx_short_id(F.lit("f3f377cdae127e47abcd"))) == signed(17578525495829626439)
    for bad in ("1" + "0" * 16, "x", ""):
        with pytest.raises(Exception, match="hexadecimal"):
            one(spark, codecs.from_hex(F.lit(bad)))


def test_pack(spark):
    pack = lambda b, a: one(spark, codecs.pack(F.lit(b), F.lit(a)))
    assert [pack(55, 3), pack(55, 4), pack(56, 5)] == [483785116221443, 483785116221444, 492581209243653]
    assert pack(1310720, 800100000000) == -6917528227541081856
    assert one(spark, codecs.amount_of(codecs.pack(F.lit(5), F.lit(2**42 + 1)))) == 2**42
    assert one(spark, codecs.block_of(codecs.pack(F.lit(2**21 - 1), F.lit(9)))) == 2**21 - 1
    for block in (2**21, -1):
        with pytest.raises(Exception, match="21 bits"):
            pack(block, 1)


def test_address_texts(spark):
    assert one(spark, codecs.address_prefix(F.lit("abcdefgh and more"))) == 0x6867666564636261
    assert one(spark, codecs.address_prefix(F.lit(TEXT))) == 6283169578688674413
    assert one(spark, codecs.address_prefix(F.lit("é" * 8))) == signed(0xE9E9E9E9E9E9E9E9)
    with pytest.raises(Exception, match="eight"):
        one(spark, codecs.address_prefix(F.lit("short")))
    df = spark.createDataFrame([(t,) for t in ["", "abc", "a" * 64, "a" * 66, "a" * 64 + "é", "a" * 65, None]], "s string")
    assert [r[0] for r in df.select(codecs.address_is_valid(F.col("s"))).collect()] == [False] * 5 + [True, None]
    assert one(spark, codecs.padded_address(F.lit("abc"))) == "abc".ljust(65, "A") and one(spark, codecs.padded_tx(F.lit("x" * 70))) == "x" * 70


def test_bytes(spark):
    data = F.lit(bytearray(b"\x01\xab\xff"))
    assert one(spark, codecs.hex_of_bytes(data)) == "01ABFF" and one(spark, codecs.hex_of_bytes(F.lit(bytearray()))) == "" and one(spark, codecs.hex_of_bytes(F.lit(None).cast("binary"))) == ""
    assert one(spark, codecs.reversed_hex(data)) == "ffab01"
    assert one(spark, codecs.to_binary_digits(data)) == "000000011010101111111111"
    assert one(spark, codecs.to_binary_digits(data, little_endian=True, grouped=True)) == "11111111 10101011 00000001"
    with pytest.raises(Exception, match="no bytes"):
        one(spark, codecs.reversed_hex(F.lit(bytearray())))


def short_id(text):
    return signed(int(generators.base58_bytes(text)[::-1].hex()[5:21], 16))


def test_base58(spark):
    known = {"161BqpuSRgdoGqiK78AfUqQi72dZtMyaaE": ("0036e1ade159a92895293b45804642df3e5d027a18b627a10b", 8890536261305232884), "1LyNyE6BVgwYnDGtFd3DC2W4SVfx2yYvAU": ("00db1405dc258d3ee32e249bdbd02720795301c09acd548751", 5537646333184676354)}
    r = random.Random(5)
    texts = [*known, *("1" * r.randint(0, 12) + "".join(r.choice(codecs.BASE58_ALPHABET) for _ in range(r.randint(15, 40))) for _ in range(200)), "1" * 11, "1" * 10 + "2"]
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    rows = df.select("s", codecs.base58_short_id(F.col("s")).alias("id"), generators.base58_decode("s").alias("b")).collect()
    for row in rows:
        assert row.id == short_id(row.s) and bytes(row.b) == generators.base58_bytes(row.s)
        if row.s in known:
            assert (bytes(row.b).hex(), row.id) == known[row.s]
    for bad in ("0abc", "2" * 5, "1" * 10):
        with pytest.raises(Exception, match="Base58|eleven"):
            one(spark, codecs.base58_short_id(F.lit(bad)))


def test_generators(spark):
    draws = [r[0] for r in spark.range(3).orderBy("id").select(generators.splitmix64(F.lit(20250825).cast("long"), "id")).collect()]
    assert [d % 2**64 for d in draws] == [12176119324329814173, 16632195146917235629, 2149617013981133878]
    found = [r[0] for r in spark.createDataFrame([(0,), (1,), (42,)], "s long").select(generators.synthetic_address("s")).collect()]
    assert found == ["MEV7gfBZj34Ekv6tM3xRoCl6pjLlyibJmSH0gfBheQHot8gz9SYjQGBrpor2co5A3", "vKO74x7bhf8tJH2TMqxnvK8eAvHu30bZGgYLkG09bElmHUzKfb1OgZl6HRVARhZGA", TEXT]
