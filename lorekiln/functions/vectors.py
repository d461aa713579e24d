"""Column expressions on vectors held as arrays, all in double precision, and the 32-bit codec."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _fold(a: Column, b: Column, term) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: term(x.cast("double"), y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def inner(a: Column, b: Column) -> Column:
    return _fold(a, b, lambda x, y: x * y)


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(_fold(a, b, lambda x, y: (x - y) * (x - y)))


def cosine(a: Column, b: Column) -> Column:
    """Null where a vector is all zero."""
    n = F.sqrt(inner(a, a)) * F.sqrt(inner(b, b))
    return F.when(n > 0, inner(a, b) / n)


def is_usable(v: Column, dim: int) -> Column:
    """``dim`` finite numbers."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) <= F.lit(3.4028235e38))
    return v.isNotNull() & (F.size(v) == dim) & F.forall(v, finite)


@F.pandas_udf(T.BinaryType())
def encode_f32(v: pd.Series) -> pd.Series:
    """Little-endian 32-bit floats."""
    return v.map(lambda x: None if x is None else np.asarray(x, dtype="<f4").tobytes())


@F.pandas_udf(T.ArrayType(T.FloatType()))
def decode_f32(b: pd.Series) -> pd.Series:
    """The floats of ``encode_f32``; null if the length is no multiple of four."""
    return b.map(lambda x: None if x is None or len(x) % 4 else np.frombuffer(x, dtype="<f4"))


def sine_embedder(dim: int):
    """A deterministic stand-in for a text embedding model: unit vector of sin(h + i) / 2 with h the sum of UTF-16 units."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        i = np.arange(dim, dtype=np.float64)
        for texts in batches:
            out = []
            for t in texts:
                if t is None:
                    out.append(None)
                    continue
                v = np.sin(float(np.frombuffer(t.encode("utf-16-le", "surrogatepass"), dtype="<u2").sum(dtype=np.int64)) + i) * 0.5
                out.append((v / np.linalg.norm(v)).astype(np.float32))
            yield pd.Series(out)

    return embed
