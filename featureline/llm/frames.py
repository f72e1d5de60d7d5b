"""What the operators share: schemas, other columns, and batches of text as bytes."""

from __future__ import annotations

from collections.abc import Callable, Hashable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

_KINDS = {"long": T.LongType(), "int": T.IntegerType(), "string": T.StringType(), "binary": T.BinaryType(),
          "boolean": T.BooleanType(), "double": T.DoubleType(), "longs": T.ArrayType(T.LongType()),
          "ints": T.ArrayType(T.IntegerType())}


def fields(text: str) -> list[T.StructField]:
    """``"a long, b string"`` as fields, also where no session is there yet."""
    return [T.StructField(*(lambda n, k: (n, _KINDS[k]))(*x.split())) for x in text.split(",")]


#: A whole row, carried through an operator whose results may have the names of its columns.
ROW = "__featureline_row"


#: The text that an operator reads, beside the other columns.
TEXT = "__featureline_text"


def whole_rows(df: DataFrame, id: str, text: str) -> DataFrame:
    """Each row as one column, with its text once more under a name that is known; the id stands beside it."""
    row = F.struct(*(F.col(f"`{c}`") for c in df.columns if c != text), F.col(text).cast("string").alias(TEXT))
    return df.select(row.alias(ROW), id, F.lit(None).cast("string").alias(text))


def text_of(batch: pa.RecordBatch) -> pa.Array:
    """The text column, or the text inside whole rows."""
    return batch.column(ROW).field(TEXT) if ROW in batch.schema.names else batch.column(TEXT)


def columns_of(df: DataFrame, text: str) -> list:
    """The columns of whole rows, under their own names."""
    return [F.col(f"{ROW}.{TEXT}").alias(c) if c == text else F.col(f"{ROW}.`{c}`").alias(c) for c in df.columns]


_held: dict = {}


def held(key: Hashable, make: Callable[[], object]):
    """What ``make`` builds. A worker keeps it for its next tasks, and only the last such object: workers live through many operators."""
    if key not in _held:
        release()
        _held[key] = make()
    return _held[key]


def release() -> None:
    """Gives back what an operator before this one kept."""
    _held.clear()


def others(df: DataFrame, *results: str) -> list[str]:
    """The columns of ``df`` that go along: all but those with the names of results."""
    return [c for c in df.columns if c not in results]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and where each row begins; null rows are empty."""
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(offsets, kind)[column.offset: column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data and data.size else np.zeros(0, np.uint8)), offsets


def parts(offsets: np.ndarray, most: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Runs of rows with about ``most`` bytes of text each; a longer row is a run of its own."""
    at, last = 0, len(offsets) - 1
    while at < last:
        end = int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1
        end = min(max(end, at + 1), last)
        yield at, end
        at = end


def record(schema: T.StructType, columns: dict) -> pa.RecordBatch:
    """A batch of the columns, in the order of the schema."""
    names = schema.fieldNames()
    return pa.RecordBatch.from_arrays([columns[n] for n in names], names=names)
