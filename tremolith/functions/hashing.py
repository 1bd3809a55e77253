"""Digests over exact bytes."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F


def feature_digest(values: Column) -> Column:
    """SHA-256 over little-endian float64 values; null hashes as the empty string."""
    @F.pandas_udf("string")
    def run(v: pd.Series) -> pd.Series:
        return v.map(lambda a: hashlib.sha256(b"" if a is None else np.asarray(a, dtype="<f8").tobytes()).hexdigest())
    return run(values)
