"""Arrow batches cut by the size of their texts."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Bytes of an Arrow batch on its way to a Python worker.
BATCH_BYTES = 4 << 20


def small_batches(docs: DataFrame) -> DataFrame:
    """``docs`` as it is; from now on the session sends texts to Python in batches of ``BATCH_BYTES``.

    The setting bounds what the JVM and a worker hold of a table of long texts; it changes no result.
    """
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return docs


def bounded_slices(batch: pa.RecordBatch, column: int, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """Slices whose texts take at most ``most_bytes`` together, a longer text alone; order and rows are kept."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends, row = np.cumsum(sizes, dtype=np.int64), 0
    while row < batch.num_rows:
        before = int(ends[row - 1]) if row else 0
        stop = max(row + 1, int(np.searchsorted(ends, before + most_bytes, "right")))
        yield batch.slice(row, stop - row)
        row = stop


def groups(batches: Iterator[pa.RecordBatch], by: int) -> Iterator[pa.RecordBatch]:
    """The runs of rows that are equal in the first ``by`` (long or int) columns, one batch each; rows arrive sorted by them."""
    open_run: list[pa.RecordBatch] = []

    def keys(batch: pa.RecordBatch, row: int) -> tuple:
        return tuple(batch.column(c)[row].as_py() for c in range(by))

    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in range(by)]
        cuts = np.nonzero(np.any([np.diff(c) != 0 for c in columns], axis=0))[0] + 1
        edges = [0, *cuts.tolist(), batch.num_rows]
        if open_run and keys(open_run[-1], 0) != keys(batch, 0):
            yield pa.concat_batches(open_run)
            open_run = []
        for a, b in zip(edges, edges[1:], strict=False):
            if a:
                yield pa.concat_batches(open_run)
                open_run = []
            open_run.append(batch.slice(a, b - a))
    if open_run:
        yield pa.concat_batches(open_run)


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text or binary column and the offsets of its rows; a null row is empty."""
    large = column.cast(pa.large_binary())
    if large.null_count:
        large = large.fill_null(b"")
    offsets = np.frombuffer(large.buffers()[1], np.int64)[large.offset : large.offset + len(large) + 1]
    data = np.frombuffer(large.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]] if len(large) else np.empty(0, np.uint8)
    return data, offsets - offsets[0]


def token_cutter(inside: np.ndarray, fold: np.ndarray):
    """A function of texts that cuts out the maximal runs of ``inside`` bytes, folded by ``fold``: lengths, rows and bytes of all tokens."""

    def cut(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        data, offsets = bytes_of(texts)
        own = np.append(inside[data], False)
        starts, ends = own[:-1].copy(), own[:-1] & ~own[1:]
        starts[1:] &= ~own[:-2]
        filled = np.diff(offsets) > 0
        starts[offsets[:-1][filled]] = own[offsets[:-1][filled]]  # a token begins and ends with its row
        ends[offsets[1:][filled] - 1] = own[offsets[1:][filled] - 1]
        first = np.flatnonzero(starts)
        row = np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(first, offsets)))
        return np.flatnonzero(ends) + 1 - first, row, fold[data[own[:-1]]]

    return cut


def strings(lengths: np.ndarray, data: np.ndarray) -> pa.Array:
    """Texts of these byte lengths, one after another in ``data``."""
    ends = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(lengths), pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data)))


class Pooled:
    """Counts by key gathered inside a task; what grows over ``most`` rows is handed on."""

    def __init__(self, keys: list[str], counts: list[str], most: int = 1 << 19):
        self.keys, self.counts, self.most, self.held = keys, counts, most, []

    def add(self, table: pa.Table) -> Iterator[pa.RecordBatch]:
        """Take in a table; yields what no longer fits."""
        self.held.append(table)
        if sum(t.num_rows for t in self.held) > self.most:
            self.held = [self._sum()]
            if self.held[0].num_rows > self.most // 2:
                yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        """All that is held."""
        if self.held:
            whole, self.held = self._sum(), []
            yield from whole.to_batches(max_chunksize=1 << 16)

    def _sum(self) -> pa.Table:
        grouped = pa.concat_tables(self.held).group_by(self.keys).aggregate([(c, "sum") for c in self.counts])
        return grouped.select([*self.keys, *[f"{c}_sum" for c in self.counts]]).rename_columns([*self.keys, *self.counts])
