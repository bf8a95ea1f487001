"""Lines that many documents share, found by streaming sorted hashes; documents get bitmaps of the lines to keep.

Every line is sent as two 64-bit hashes of its key with its document and position, never as text. The rows are dealt by
range of (hashes, document, position), so a line that a third of all documents hold is spread over many tasks, and
sorted. A task streams its range: it sees the documents of a key one after the other, each with its first occurrence,
and says which occurrences go. Only the first and the last key of a range can go on in another one; their counts, a few
rows for each task, are added up afterwards. What comes back is a compressed bitmap for each document.

Rows equal in doc_id and text are one document given several times: each counts, and all get the same bitmap. Null texts
are one empty line; null doc_ids are documents like others; an empty table gives an empty result; other columns are
ignored. A very long text is cut into lines by the JVM as it is read; a task holds one text and one batch of hashes.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatledger.llm.common import stored

BLANKS = " \t\n\v\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: States of an occurrence after the stream: it goes; its key goes on in another range and is too rare in this one; it is
#: the first of its key here, which may be the first of all; or the row has the count of a key in this range.
GOES, OPEN, FIRST, COUNT = 0, 1, 2, 3

_STREAMED = "h1 long, h2 long, d long, d1 long, d2 long, pos int, n long, state int"


def line_key(line: Column) -> Column:
    """The line without blanks at both ends, A to Z in lower case."""
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


def _keyed(documents: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return documents.select(
        "doc_id", text.alias("text"), F.xxhash64("doc_id", text).alias("d1"), F.xxhash64(F.lit(7), text, "doc_id").alias("d2"))


def _occurrences(keyed: DataFrame, min_chars: int) -> DataFrame:
    """h1, h2, d, d1, d2, pos, first, part: every line whose key is long enough; ``first`` marks the first of its key in
    its document, and ``part`` only parts rows that are equal otherwise."""
    keys = F.transform(F.split("text", "\n"), line_key)
    lines = keyed.select(F.col("doc_id").cast("long").alias("d"), "d1", "d2", F.posexplode(keys).alias("pos", "key"))
    lines = lines.where(F.char_length("key") >= min_chars)
    return lines.select(
        F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(3), "key").alias("h2"), "d", "d1", "d2", "pos",
        F.spark_partition_id().alias("part"))


def _stream(min_docs: int, keep_first: bool):
    """One pass over a sorted range. ``w`` counts the documents of a key: it is 1 on rows with the position at which their
    document has the key first, so that a document given twice counts twice. Rows of the key that is still open at the
    end of a batch are carried on while it is too rare to go; afterwards its first row alone is, with all their weight."""
    columns = ("h1", "h2", "d", "d1", "d2", "pos")
    document = ("d", "known", "d1", "d2")

    def rows(part: dict[str, np.ndarray], state: int, n: int = 0) -> pa.RecordBatch:
        size = len(part["h1"])
        arrays = [pa.array(part[c], mask=~part["known"] if c == "d" else None) for c in columns]
        arrays += [pa.array(np.full(size, n)), pa.array(np.full(size, state, np.int32))]
        return pa.RecordBatch.from_arrays(arrays, [*columns, "n", "state"])

    def border(part: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        """A key that may go on in another range."""
        count = int(part["w"].sum())
        one = {c: v[:1] for c, v in part.items()}
        if count < min_docs:
            yield rows(part, OPEN)
        elif keep_first:
            yield rows(one, FIRST)
        yield rows(one, COUNT, count)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried, doc, first_pos, edge = None, None, -1, True
        for batch in batches:
            size = batch.num_rows
            if not size:
                continue
            cols = {c: batch.column(c).fill_null(0).to_numpy() for c in columns}
            cols["known"] = np.asarray(batch.column("d").is_valid())
            opened = _changes(cols, ("h1", "h2", *document))
            opened[0] = doc != tuple(cols[c][0] for c in ("h1", "h2", *document))
            at = np.maximum.accumulate(np.where(opened, np.arange(size), -1))
            first = np.where(at >= 0, cols["pos"][at], first_pos)
            cols["w"], cols["own"] = (cols["pos"] == first).astype(np.int64), np.ones(size, bool)
            doc, first_pos = tuple(cols[c][-1] for c in ("h1", "h2", *document)), int(first[-1])
            if carried is not None:
                cols = {c: np.concatenate([carried[c], v]) for c, v in cols.items()}
            starts = np.flatnonzero(_changes(cols, ("h1", "h2")))
            total = np.add.reduceat(cols["w"], starts)
            sizes = np.diff([*starts, len(cols["w"])])
            gone = np.repeat(total >= min_docs, sizes) & cols["own"]
            if keep_first:
                lead = np.repeat(starts, sizes)
                gone &= ~np.logical_and.reduce([cols[c] == cols[c][lead] for c in (*document, "pos")])
            if gone.any():
                yield rows({c: v[gone] for c, v in cols.items()}, GOES)
            if edge and len(starts) > 1:
                yield from border({c: v[: starts[1]] for c, v in cols.items()})
                edge = False
            if total[-1] < min_docs:
                carried = {c: v[starts[-1] :] for c, v in cols.items()}
            else:
                carried = {c: v[starts[-1] : starts[-1] + 1] for c, v in cols.items()}
                carried |= {"w": total[-1:], "own": np.zeros(1, bool)}
        if carried is not None:
            yield from border(carried)

    return run


def _changes(cols: dict[str, np.ndarray], names: tuple[str, ...]) -> np.ndarray:
    """Where a row differs from the one before; the first row does."""
    return np.concatenate([[True], np.logical_or.reduce([cols[c][1:] != cols[c][:-1] for c in names])])


def dropped_lines(keyed: DataFrame, *, min_docs: int, min_chars: int, keep_first: bool) -> DataFrame:
    """d1, d2, pos: the lines that go."""
    order = ["h1", "h2", "d", "d1", "d2", "pos", "part"]
    dealt = _occurrences(keyed, min_chars).repartitionByRange(*order).sortWithinPartitions(*order)
    streamed = stored(dealt.mapInArrow(_stream(min_docs, keep_first), _STREAMED), "lines")
    place = F.struct(F.col("d").alias("d"), F.col("d1").alias("d1"), F.col("d2").alias("d2"), F.col("pos").alias("pos"))
    counts = streamed.where(F.col("state") == COUNT).groupBy("h1", "h2").agg(F.sum("n").alias("c"), F.min(place).alias("lead"))
    edges = streamed.where(F.col("state").isin(OPEN, FIRST)).join(counts.where(F.col("c") >= min_docs), ["h1", "h2"])
    if keep_first:
        edges = edges.where(place != F.col("lead"))
    return streamed.where(F.col("state") == GOES).select("d1", "d2", "pos").union(edges.select("d1", "d2", "pos"))


def keep_bitmaps(
    documents: DataFrame, *, min_docs: int = 2, min_chars: int = 1, keep_first: bool = True
) -> DataFrame:
    """doc_id, d1, d2 (two hashes that tell the document), n_lines, n_dropped, keep: for every row of ``documents`` which
    of its lines stay. Keys of at least ``min_chars`` code points found in at least ``min_docs`` documents lose all
    their lines, with ``keep_first`` all but the first by document and position. ``keep`` is a zlib-compressed bitmap, one
    bit a line, the first line in the highest bit of the first byte."""
    return _with_drops(documents, min_docs, min_chars, keep_first).select(
        "doc_id", "d1", "d2", F.size(F.split("text", "\n")).cast("long").alias("n_lines"), "gone"
    ).mapInArrow(_bitmaps, "doc_id long, d1 long, d2 long, n_lines long, n_dropped long, keep binary")


def _with_drops(documents: DataFrame, min_docs: int, min_chars: int, keep_first: bool) -> DataFrame:
    keyed = _keyed(documents)
    lines = dropped_lines(keyed, min_docs=min_docs, min_chars=min_chars, keep_first=keep_first)
    gone = lines.groupBy("d1", "d2").agg(F.collect_set("pos").alias("gone"))
    return keyed.join(gone, ["d1", "d2"], "left")


def _bitmap(n_lines: int, gone: np.ndarray) -> bytes:
    keep = np.ones(n_lines, bool)
    keep[gone] = False
    return zlib.compress(np.packbits(keep).tobytes(), 1)


def kept_bits(bitmap: bytes, n_lines: int) -> np.ndarray:
    """A compressed bitmap as one boolean for each line."""
    return np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), count=n_lines).astype(bool)


def _lists(column: pa.Array) -> Iterator[np.ndarray]:
    values, offsets = np.asarray(column.values), np.asarray(column.offsets)
    for i, known in enumerate(np.asarray(column.is_valid())):
        yield values[offsets[i] : offsets[i + 1]] if known else values[:0]


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        gone = list(_lists(batch.column("gone")))
        lines = batch.column("n_lines").to_pylist()
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("d1"), batch.column("d2"), batch.column("n_lines"),
             pa.array([len(g) for g in gone], pa.int64()),
             pa.array([_bitmap(n, g) for n, g in zip(lines, gone, strict=True)], pa.binary())],
            ["doc_id", "d1", "d2", "n_lines", "n_dropped", "keep"])


def apply_bitmaps(documents: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept (the lines that stay, joined by line feeds) of every row of ``documents``."""
    one = bitmaps.groupBy("d1", "d2").agg(F.first("keep").alias("keep"))
    return _keyed(documents).join(one, ["d1", "d2"], "left").select("doc_id", "text", "keep").mapInArrow(
        _apply, "doc_id long, n_lines long, n_dropped long, kept string")


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, dropped, kept = [], [], []
        for text, bitmap in zip(batch.column("text").to_pylist(), batch.column("keep").to_pylist(), strict=True):
            lines = text.split("\n")
            bits = kept_bits(bitmap, len(lines)) if bitmap is not None else np.ones(len(lines), bool)
            sizes.append(len(lines))
            dropped.append(len(lines) - int(bits.sum()))
            kept.append("\n".join([x for x, b in zip(lines, bits, strict=True) if b]))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(dropped, pa.int64()), pa.array(kept, pa.string())],
            ["doc_id", "n_lines", "n_dropped", "kept"])


def remove_shared(
    documents: DataFrame, *, min_docs: int = 10, min_chars: int = 1, keep_first: bool = False
) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of every row of ``documents``: bitmaps made and applied at once, so that the
    texts are shuffled a single time."""
    return _with_drops(documents, min_docs, min_chars, keep_first).select("doc_id", "text", "gone").mapInArrow(
        _digests, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, dropped, digests = [], [], []
        for text, gone in zip(batch.column("text").to_pylist(), _lists(batch.column("gone")), strict=True):
            lines = text.split("\n")
            if len(gone):
                bits = kept_bits(_bitmap(len(lines), gone), len(lines))
                text = "\n".join([x for x, b in zip(lines, bits, strict=True) if b])
            sizes.append(len(lines))
            dropped.append(len(gone))
            digests.append(hashlib.sha256(text.encode()).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(dropped, pa.int64()), pa.array(digests, pa.string())],
            ["doc_id", "n_lines", "n_dropped", "kept_sha256"])


def oracle(min_docs: int = 10, min_chars: int = 1) -> str:
    """SQL for ``remove_shared``."""
    blanks = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return f"""
        WITH docs AS (
            SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
        ), lines AS (
            SELECT r, doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS i FROM docs
        ), keyed AS (
            SELECT *, translate(trim(line, {blanks}), '{UPPER}', '{LOWER}') AS key FROM lines
        ), shared AS (
            SELECT key FROM keyed WHERE length(key) >= {min_chars} GROUP BY key HAVING count(DISTINCT r) >= {min_docs}
        )
        SELECT doc_id, count(*) AS n_lines, count(s.key) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE s.key IS NULL), '')) AS kept_sha256
        FROM keyed k LEFT JOIN shared s ON k.key = s.key GROUP BY r, doc_id"""
