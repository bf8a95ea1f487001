"""Small helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chatledger.plans.materialize import cut_lineage, scratch_path

#: Word separators: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = "[\\x20\\x09-\\x0D]+"

__all__ = ["SPACES", "cut_lineage", "flat_text", "free_name", "odd_bytes", "row_key", "slices", "stored", "table", "words"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(rows: DataFrame, label: str) -> DataFrame:
    """The rows written to the shared folder as Parquet and read back: cuts the lineage as ``cut_lineage`` does, in about
    half the space."""
    path = scratch_path(rows.sparkSession, label)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def free_name(columns: list[str], name: str) -> str:
    """``name``, with underscores behind it until no column is called so (letters of either case are the same)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def row_key(rows: DataFrame) -> Column:
    """128 bits that tell rows apart: two hashes of all columns and of which of them are null (hashes pass nulls over),
    maps by their sorted entries."""
    parts = [F.col(f.name).isNull() for f in rows.schema.fields]
    parts += [F.array_sort(F.map_entries(f.name)) if f.dataType.typeName() == "map" else F.col(f.name)
             for f in rows.schema.fields]
    return F.struct(F.xxhash64(*parts).alias("a"), F.xxhash64(F.lit(1), *parts).alias("b"))


def words(text: str | Column) -> Column:
    """The words of a text as an array; a null text has none."""
    text = F.col(text) if isinstance(text, str) else text
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def flat_text(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an Arrow string column, without a copy, and where each text begins and ends
    (one offset more than texts). Nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if column.null_count:
        sizes = np.where(np.asarray(column.is_null()), 0, np.diff(offsets))
        column = column.fill_null(b"")
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        data = column.buffers()[2]
        start = np.frombuffer(column.buffers()[1], np.int64)[column.offset]
        offsets = offsets + start
    else:
        data = column.buffers()[2]
    flat = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return flat, offsets


def slices(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about ``most`` bytes each; a longer text is a range of its own."""
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1
        last = min(max(last, first + 1), rows)
        yield first, last
        first = last


def odd_bytes(seed: int, count: int) -> np.ndarray:
    """``count`` fixed pseudo-random odd 64-bit numbers."""
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 2**64, count, np.uint64) | np.uint64(1)
