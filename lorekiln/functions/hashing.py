"""Hashes, derived ids, and the codecs of the bundle pipeline."""

from __future__ import annotations

import gzip
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The largest chunk; below, the prefixes and forms of ids and keys.
CHUNK_LIMIT = 1_000_000


def sha256(v: Column) -> Column:
    return F.sha2(v.cast("binary"), 256)


def bundle_id(key: Column) -> Column:
    """Fixed values, here and in the two functions below: prefixes, lengths and the order of the parts."""
    return F.concat(F.lit("bndl_"), F.substring(key, 1, 32))


def commit_id(key: Column) -> Column:
    return F.concat(F.lit("cmt_"), F.substring(key, 1, 64))


def idempotency_key(commit: Column, index: Column, chunk_hash: Column) -> Column:
    return sha256(F.concat_ws(":", commit, index.cast("string"), chunk_hash))


def chunk_count(length: Column, size: int) -> Column:
    """At least one, also for an empty payload."""
    return F.greatest(F.lit(1), F.ceil(length / F.lit(size))).cast("int")


def to_base64(v: Column) -> Column:
    """Base64 on one line, whatever the session's setting for line ends is."""
    return F.regexp_replace(F.base64(v), r"[\r\n]", "")


def from_base64(text: Column) -> Column:
    """The bytes; null if the text is no base64."""
    return F.try_to_binary(text, F.lit("base64"))


@F.pandas_udf(T.BinaryType())
def gzip_bytes(b: pd.Series) -> pd.Series:
    """gzip without a time stamp, so equal input gives equal output."""
    return b.map(lambda x: None if x is None else gzip.compress(bytes(x), 6, mtime=0))


@F.pandas_udf(T.BinaryType())
def gunzip_bytes(b: pd.Series) -> pd.Series:
    """Unpacks gzip, told by its first two bytes; other data pass through; damaged gzip gives null."""

    def one(x):
        if x is None or bytes(x[:2]) != b"\x1f\x8b":
            return x
        try:
            return gzip.decompress(bytes(x))
        except (OSError, EOFError, ValueError):
            return None

    return b.map(one)


@F.pandas_udf(T.StringType())
def canonical_json(text: pd.Series) -> pd.Series:
    """Compact JSON with sorted keys at every level; null if unreadable."""

    def one(x):
        try:
            return None if x is None else json.dumps(json.loads(x), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        except ValueError:
            return None

    return text.map(one)


def encrypt(plain: Column, key: bytes, nonce: Column) -> Column:
    """AES-256-GCM: nonce (12 bytes), cipher text and tag (16 bytes), in that order; ``decrypt`` is its inverse."""
    if len(key) != 32:
        raise ValueError("the key must have 32 bytes")
    return F.aes_encrypt(plain, F.lit(key), F.lit("GCM"), F.lit("DEFAULT"), nonce)


def decrypt(sealed: Column, key: bytes) -> Column:
    """The plain bytes; null if the key is wrong or the data were changed."""
    if len(key) != 32:
        raise ValueError("the key must have 32 bytes")
    return F.try_aes_decrypt(sealed, F.lit(key), F.lit("GCM"))
