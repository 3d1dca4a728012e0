"""Digests of numeric arrays."""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T


def array_bytes(values: np.ndarray) -> bytes:
    """A header (type and shape as JSON, a line end) and the values, little-endian."""
    little = np.ascontiguousarray(values).astype(values.dtype.newbyteorder("<"))
    return json.dumps({"dtype": little.dtype.str, "shape": list(little.shape)}, sort_keys=True).encode() + b"\n" + little.tobytes()


@F.arrow_udf(T.StringType())
def array_digest(column: pa.Array) -> pa.Array:
    """SHA-256 of each array of doubles; null for null."""
    return pa.array([None if v is None else hashlib.sha256(array_bytes(np.array(v, float))).hexdigest() for v in column.to_pylist()], pa.string())
