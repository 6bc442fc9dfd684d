"""Vector functions over array<float> columns, JVM side."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """0 where widths differ, a side is null or empty, or a norm is 0."""
    na, nb = norm(a) if norm_a is None else norm_a, norm(b) if norm_b is None else norm_b
    usable = (F.size(a) == F.size(b)) & (F.size(a) > 0) & (na > 0) & (nb > 0)
    return F.when(F.coalesce(usable, F.lit(False)), dot(a, b) / (na * nb)).otherwise(0.0)


def l2_normalize(v: Column) -> Column:
    """A zero vector stays as it is."""
    length = norm(v)
    return F.when(length > 0, F.transform(v, lambda x: x.cast("double") / length)).otherwise(F.transform(v, lambda x: x.cast("double")))


def vector_literal(values: Sequence[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in values))


def decode_float32(blob: Column) -> Column:
    """Little-endian float32 bytes as array<float>; null for empty input or a length that is no multiple of 4."""

    @F.pandas_udf("array<float>")
    def run(column: pd.Series) -> pd.Series:
        return column.map(lambda b: np.frombuffer(b, "<f4") if b is not None and len(b) and len(b) % 4 == 0 else None)

    return run(blob)
