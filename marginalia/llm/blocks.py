"""Whole documents in blocks, and exchanges of what blocks know about shared keys.

A block is one row: some megabytes of documents as a compressed Arrow stream. Statistics that would
need a row for each token or position travel as packed arrays instead: each block sends each key
once to the bucket that owns the key's range, and the bucket answers the block by the entry's place.
A key thus has at most one entry for each block, however often it occurs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow
from ..session import stash

BLOCK_BYTES = 4 << 20
ANSWERS = "block long, answers array<struct<bucket:long,body:binary>>"


def to_bytes(table: pa.Table | pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 6))) as out:
        out.write(table)
    return sink.getvalue().to_pybytes()


def from_bytes(body: bytes) -> pa.Table:
    with pa.ipc.open_stream(body) as stream:
        return stream.read_all().combine_chunks()


def blocks(docs: DataFrame, text_col: str, name: str, block_bytes: int = BLOCK_BYTES, sampler=None) -> DataFrame:
    """Written rows (block, n_bytes, docs, sample); sampler gives a few keys of each block."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        held, size = [], 0

        def row() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            sample = sampler(table) if sampler else []
            return pa.RecordBatch.from_arrays(
                [pa.array([block]), pa.array([size], pa.int64()), pa.array([to_bytes(table)], pa.binary()), pa.array([sample], pa.list_(pa.int64()))],
                names=["block", "n_bytes", "docs", "sample"],
            )

        for batch in batches:
            sizes = np.cumsum(pa.compute.binary_length(batch.column(text_col)).fill_null(0).to_numpy(zero_copy_only=False))
            start = 0
            while start < batch.num_rows:
                before = sizes[start - 1] if start else 0
                stop = int(np.searchsorted(sizes, before + block_bytes - size, "left")) + 1
                stop = min(stop, batch.num_rows)
                held.append(batch.slice(start, stop - start))
                size += int(sizes[stop - 1] - before)
                start = stop
                if size >= block_bytes:
                    yield row()
                    held, size, block = [], 0, block + 1
        if held:
            yield row()

    return stash(map_arrow(docs, pack, "block long, n_bytes long, docs binary, sample array<long>"), name)


def text_buffer(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All texts' UTF-8 bytes in a row, and the n + 1 bounds; a null text is empty."""
    texts = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.chunk(0) if texts.num_chunks else pa.array([], pa.string())
    texts = pa.compute.fill_null(texts, "").cast(pa.large_string())
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[bounds[0] : bounds[-1]] if len(bounds) else raw, bounds - (bounds[0] if len(bounds) else 0)


def ids_of(table: pa.Table, id_col: str) -> np.ndarray:
    """Ids as 64-bit integers; a null id is greater than every other."""
    return pa.compute.fill_null(table.column(id_col).cast(pa.int64()), np.iinfo(np.int64).max).to_numpy()


def send(block: int, owner: np.ndarray, ids: np.ndarray, *arrays: np.ndarray) -> Iterator[dict]:
    """A row for each bucket in owner, which ascends: the arrays' parts that it owns. Ids go as 32-bit
    distances from the least where they fit."""
    base = int(ids.min()) if len(ids) else 0
    short = len(ids) > 0 and int(ids.max()) - base < 1 << 32
    packed = (ids - base).astype("<u4") if short else ids.astype("<i8")
    starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]) if len(owner) else []
    for start, stop in zip(starts, [*starts[1:], len(owner)]):
        parts = [np.ascontiguousarray(x[start:stop]) for x in (packed, *arrays)]
        head = np.array([stop - start, base, short], "<i8").tobytes()
        yield {"bucket": int(owner[start]), "block": block, "body": head + b"".join(x.tobytes() for x in parts)}


def receive(table: pa.Table, *kinds: str) -> tuple[list[int], np.ndarray, list[np.ndarray]]:
    """All entries that reached a bucket: the blocks, each entry's block (as a place in that list),
    and the ids and arrays joined."""
    froms = table.column("block").to_pylist()
    counts, columns = [], [[] for _ in range(len(kinds) + 1)]
    for body in table.column("body").to_pylist():
        n, base, short = np.frombuffer(body, "<i8", 3).tolist()
        counts.append(n)
        at = 24
        for k, kind in enumerate(("<u4" if short else "<i8", *kinds)):
            column = np.frombuffer(body, kind, n, at)
            columns[k].append(column.astype(np.int64) + base if short and not k else column)
            at += n * np.dtype(kind).itemsize
    return froms, np.repeat(np.arange(len(froms)), counts), [np.concatenate(x) for x in columns]


def answers(rows: DataFrame) -> DataFrame:
    return rows.groupBy("block").agg(F.collect_list(F.struct("bucket", "body")).alias("answers"))


def multikey_sort(*columns: np.ndarray) -> np.ndarray:
    """The order by the first column, ties by the second and so on: each further column only
    splits the runs that are still tied, as multikey quicksort does."""
    order = np.argsort(columns[0], kind="stable")
    if len(columns) == 1 or len(order) < 2:
        return order
    first = columns[0][order]
    new = np.r_[True, first[1:] != first[:-1]]
    run = np.cumsum(new)
    for column in columns[1:]:
        tied = np.flatnonzero(~(new & np.r_[new[1:], True]))
        if not len(tied):
            break
        order[tied] = order[tied][np.lexsort((column[order[tied]], run[tied]))]
        values = column[order]
        new = new | np.r_[True, values[1:] != values[:-1]]
        run = np.cumsum(new)
    return order
