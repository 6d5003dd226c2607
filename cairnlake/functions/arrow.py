"""Rows as Arrow arrays of structs, for functions that find several things in a text."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_type

Fields = list[tuple[str, pa.DataType]]


def struct_of(fields: Fields) -> T.StructType:
    return T.StructType([T.StructField(name, from_arrow_type(kind)) for name, kind in fields])


def structs(rows: list[tuple | None], fields: Fields) -> pa.StructArray:
    """Tuples, or None for null, as structs."""
    empty = (None,) * len(fields)
    columns = list(zip(*[r or empty for r in rows], strict=True)) or [()] * len(fields)
    arrays = [pa.array(c, kind) for c, (_, kind) in zip(columns, fields, strict=True)]
    return pa.StructArray.from_arrays(arrays, fields=[pa.field(name, kind) for name, kind in fields], mask=pa.array([r is None for r in rows], pa.bool_()))


def lists(rows: list[list[tuple | None] | None], fields: Fields) -> pa.ListArray:
    """Lists of tuples, or None for null, as arrays of structs."""
    at, offsets = 0, []
    for r in rows:
        offsets.append(None if r is None else at)
        at += len(r or ())
    return pa.ListArray.from_arrays(pa.array([*offsets, at], pa.int32()), structs([x for r in rows for x in r or ()], fields))


def joined(texts: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of texts without nulls one after the other, with a line feed after each, and where each begins, then where the last ends."""
    ended = pc.binary_join_element_wise(texts, *(pa.scalar(x, pa.large_string()) for x in ("", "\n")))
    bounds = np.frombuffer(ended.buffers()[1], np.int64)[: len(ended) + 1] if len(ended) else np.zeros(1, np.int64)
    return bounds, np.frombuffer(ended.buffers()[2] or b"", np.uint8)[: bounds[-1]]
