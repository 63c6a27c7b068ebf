"""SimHash near-duplicates by a segment-popcount embedding.

Fingerprints: 64 majority bits over XXH64 (seed 42) of word shingles.

Linking (at most ``radius`` differing bits): a fingerprint is cut into 32 segments of
two bits and embedded as its 32 bit counts.  The Manhattan distance of two embeddings
never exceeds their Hamming distance.  Counts are kept in unary (0, 1, 2 -> 00, 01, 11),
so the embedding is again 64 bits and Manhattan distance is the popcount of an XOR.

Grid range-join: the 32 axes fall into ``bands`` groups.  Two points within Manhattan
distance ``radius`` agree on at least ``bands - radius`` whole groups, hence share a cell
of the grid over one choice of groups; every point is dealt to its cell in each choice.
Within a cell the Manhattan bound prunes and the Hamming distance decides.  A cell emits
a spanning forest of its links, never all pairs.  Cells above ``cell_rows`` points are
split in chunks that meet pairwise, so no task holds an unbounded cell and no link is lost.

Equal fingerprints collapse to one point before the join, so copies cost one row.

Defined cases: a null or wordless text has fingerprint zero and is linked like any other;
fewer words than a shingle give one shingle of all of them; rows sharing a doc_id are
rows of their own; null doc_ids are never the smallest id unless a component has no
other; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fernloom.llm.batches import small_batches
from fernloom.llm.components import connected_components
from fernloom.scratch import materialize

LOW_BITS = 0x5555555555555555
BLOCK = 1 << 16


def fingerprint(text: str | None, shingle_words: int = 4, seed: int = 42) -> int:
    """Unsigned 64-bit SimHash; bytes.lower and bytes.split are the contract's A-Z and white space."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined, size = b" ".join(words), min(shingle_words, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(words) - size + 1
    starts, ends, ones = starts[:n].tolist(), ends[size - 1 :].tolist(), np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, BLOCK):  # bounded scratch for very long texts
        hashes = np.array([digest(joined[a:b], seed) for a, b in zip(starts[at : at + BLOCK], ends[at : at + BLOCK], strict=True)], np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle_words: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fp)``; fp is the fingerprint as a signed long."""
    own = small_batches(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = f"doc_id {own.schema['doc_id'].dataType.simpleString()}, fp long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), shingle_words) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], ["doc_id", "fp"])

    return own.mapInArrow(run, schema)


def embed(fp: Column) -> Column:
    """Bit counts of the 32 two-bit segments, in unary, packed in one long."""
    low, high = fp.bitwiseAND(F.lit(LOW_BITS)), F.shiftrightunsigned(fp, 1).bitwiseAND(F.lit(LOW_BITS))
    return F.shiftleft(low.bitwiseAND(high), 1).bitwiseOR(low.bitwiseOR(high))


def _embed(fp: np.ndarray) -> np.ndarray:
    low, high = fp & np.uint64(LOW_BITS), (fp >> np.uint64(1)) & np.uint64(LOW_BITS)
    return ((low & high) << np.uint64(1)) | (low | high)


def band_masks(bands: int, radius: int) -> list[int]:
    """Masks of the grid's choices of groups, as signed longs."""
    if not radius < bands <= 32:
        raise ValueError("bands must be more than radius and at most 32")
    edges = [round(i * 32 / bands) for i in range(bands + 1)]
    groups = [((1 << 2 * (b - a)) - 1) << 2 * a for a, b in zip(edges, edges[1:], strict=False)]
    masks = [sum(c) for c in combinations(groups, bands - radius)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def default_bands(points: int) -> int:
    """More groups (finer cells, more choices) for more points; any value links exactly."""
    return 6 if points < 50_000_000 else 7 if points < 3_000_000_000 else 8


class _Forest:
    """Union-find over the few points that turn out to be linked."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


SMALL = 48


def _near(fp_a, fp_b, radius):
    close = np.bitwise_count(_embed(fp_a) ^ _embed(fp_b)) <= radius  # lower bound first
    close[close] = np.bitwise_count(fp_a[close] ^ fp_b[close]) <= radius
    return close


def cell_links(starts: np.ndarray, fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Spanning forests of the links within each cell; cells are runs of rows beginning at ``starts``."""
    sizes = np.diff(np.append(starts, len(fps)))
    links: list[tuple[int, int]] = []
    small = np.repeat((sizes <= SMALL) & (sizes > 1), sizes)
    cell = np.repeat(np.arange(len(sizes)), sizes)
    rows = np.nonzero(small)[0]
    most = int(sizes[(sizes <= SMALL)].max(initial=1))
    forest = _Forest()
    for step in range(1, most):
        rows = rows[rows + step < len(fps)]
        rows = rows[cell[rows] == cell[rows + step]]
        hit = rows[_near(fps[rows], fps[rows + step], radius)]
        for a, b in zip(fps[hit].tolist(), fps[hit + step].tolist(), strict=True):
            if a != b and forest.join(a, b):
                links.append((a, b))
    for k in np.nonzero(sizes > SMALL)[0]:
        own = np.unique(fps[starts[k] : starts[k] + sizes[k]])
        left = np.ones(len(own), bool)
        left[0] = False
        frontier, rest = [0], np.nonzero(left)[0]
        while len(rest) or frontier:
            if not frontier:  # next tree
                frontier, rest = [int(rest[0])], rest[1:]
                continue
            a = frontier.pop()
            if len(rest):
                hit = _near(np.broadcast_to(own[a], rest.shape), own[rest], radius)
                for b in rest[hit].tolist():
                    frontier.append(b)
                    links.append((int(own[a]), int(own[b])))
                rest = rest[~hit]
    return links


def _link_cells(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows arrive sorted by (grid, cell, part); a cell may span batches and is carried over."""
        carry = None

        def out(arrays, final):
            grid, cell, part, fps = arrays
            change = np.nonzero((np.diff(grid) != 0) | (np.diff(cell) != 0) | (np.diff(part) != 0))[0] + 1
            starts = np.concatenate(([0], change)).astype(np.int64)
            cut = len(fps) if final else int(starts[-1])
            links = cell_links(starts if final else starts[:-1], fps[:cut].view(np.uint64), radius) if cut else []
            u, v = (np.array([x[i] for x in links], np.uint64).view(np.int64) for i in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"]), [x[cut:] for x in arrays]

        for batch in batches:
            arrays = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
            if carry is not None:
                arrays = [np.concatenate(x) for x in zip(carry, arrays, strict=True)]
            if len(arrays[0]):
                done, carry = out(arrays, False)
                yield done
        if carry is not None and len(carry[0]):
            yield out(carry, True)[0]

    return run


def links(points: DataFrame, radius: int = 4, bands: int | None = None, cell_rows: int = 4096) -> DataFrame:
    """Links ``(u, v)`` whose components are those of all pairs of ``points.fp`` within ``radius`` bits."""
    masks = band_masks(bands or default_bands(points.count()), radius)
    unary = points.select("fp", embed(F.col("fp")).alias("e"))
    dealt = unary.select(
        "fp", F.explode(F.array(*[F.struct(F.lit(i).cast("short").alias("grid"), F.col("e").bitwiseAND(F.lit(m)).alias("cell")) for i, m in enumerate(masks)])).alias("c")
    ).select("c.grid", "c.cell", "fp")
    hot = materialize(
        dealt.groupBy("grid", "cell").agg(F.count("*").alias("n")).where(F.col("n") > cell_rows).select("grid", "cell", F.ceil(F.col("n") / (cell_rows / 2)).cast("int").alias("k")),
        "hot-cells",
    )
    dealt = dealt.withColumn("part", F.lit(0))
    if not hot.isEmpty():
        # a hot cell of k chunks: chunk c meets chunk j in part (min, max); each row goes to k parts
        chunk = F.pmod(F.xxhash64("fp"), F.col("k")).cast("int")
        j = F.explode(F.when(F.col("k").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("k") - 1)))
        split = dealt.drop("part").join(hot, ["grid", "cell"], "left").select("grid", "cell", "fp", "k", chunk.alias("c"), j.alias("j"))
        dealt = split.select("grid", "cell", "fp", F.when(F.col("k").isNull(), 0).otherwise(F.least("c", "j") * F.col("k") + F.greatest("c", "j")).alias("part"))
    dealt = dealt.select("grid", "cell", "part", "fp").repartition("grid", "cell", "part").sortWithinPartitions("grid", "cell", "part")
    return dealt.mapInArrow(_link_cells(radius), "u long, v long")


def near_duplicates(docs: DataFrame, shingle_words: int = 4, radius: int = 4, bands: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fp, component_id, n_copies)`` for every row of ``docs``.

    component_id is the smallest doc_id reachable over links of at most ``radius`` bits;
    n_copies counts the rows with the same fingerprint.
    """
    fps = materialize(fingerprints(docs, shingle_words, id_col, text_col), "fingerprints")
    points = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("n_copies")), "points")
    nodes = connected_components(links(points, radius, bands))
    named = materialize(nodes.join(points.withColumnRenamed("fp", "node"), "node").select("node", "root", "first_doc"), "nodes")
    heads = named.groupBy("root").agg(F.min("first_doc").alias("component_id"))
    linked = named.join(heads, "root").select(F.col("node").alias("fp"), "component_id")
    classes = materialize(
        points.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "first_doc").alias("component_id"), "n_copies"), "classes"
    )
    return fps.join(classes, "fp").select("doc_id", "fp", "component_id", "n_copies")


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query over all of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = near_duplicates(docs)
    return out.select("doc_id", hex16(F.col("fp")).alias("fingerprint"), "component_id", "n_copies")
