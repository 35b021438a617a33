"""Functions that Spark's arithmetic can't express: wrapping 64-bit generators and whole Base58 decoding, as Arrow-batched UDFs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .codecs import ADDRESS_LENGTH, BASE58_ALPHABET

#: Fixed values of the public splitmix64 generator.
GAMMA, MIX_1, MIX_2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
#: Fixed values of synthetic addresses.
ADDRESS_ALPHABET = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
ADDRESS_SEED = 0x123456789ABCDEF0


def mix(z: np.ndarray) -> np.ndarray:
    z = (z ^ z >> np.uint64(30)) * np.uint64(MIX_1)
    z = (z ^ z >> np.uint64(27)) * np.uint64(MIX_2)
    return z ^ z >> np.uint64(31)


def draws(seed: np.ndarray, index: np.ndarray) -> np.ndarray:
    """The draw number index, from 0, of generators with the given seeds: no draw depends on another."""
    return mix(seed + (index + np.uint64(1)) * np.uint64(GAMMA))


@F.pandas_udf(T.LongType())
def splitmix64(seed: pd.Series, index: pd.Series) -> pd.Series:
    """The index-th draw, from 0, of a generator started with the seed."""
    return pd.Series(draws(seed.to_numpy(np.int64).view(np.uint64), index.to_numpy(np.int64).view(np.uint64)).view(np.int64))


@F.pandas_udf(T.LongType())
def splitmix64_mix(x: pd.Series) -> pd.Series:
    """The generator's finaliser alone."""
    return pd.Series(mix(x.to_numpy(np.int64).view(np.uint64)).view(np.int64))


@F.pandas_udf(T.StringType())
def synthetic_address(seed: pd.Series) -> pd.Series:
    """65 characters drawn from the alphabet by a generator started with seed plus a constant."""
    start = seed.to_numpy(np.int64).view(np.uint64) + np.uint64(ADDRESS_SEED)
    found = draws(start[:, None], np.arange(ADDRESS_LENGTH, dtype=np.uint64)[None, :]) % np.uint64(len(ADDRESS_ALPHABET))
    letters = np.frombuffer(ADDRESS_ALPHABET.encode(), np.uint8)[found.astype(np.int64)]
    return pd.Series([row.tobytes().decode() for row in letters], dtype=object)


def base58_bytes(text: str) -> bytes:
    value = 0
    for c in text:
        digit = BASE58_ALPHABET.find(c)
        if digit < 0:
            raise ValueError(f"{c!r} is no Base58 character")
        value = value * 58 + digit
    return bytes(len(text) - len(text.lstrip("1"))) + value.to_bytes((value.bit_length() + 7) // 8, "big")


@F.pandas_udf(T.BinaryType())
def base58_decode(text: pd.Series) -> pd.Series:
    """All bytes of a Base58 text, a zero byte for each leading 1; other characters are an error; the checksum isn't verified."""
    return text.map(lambda x: None if x is None else base58_bytes(x))
