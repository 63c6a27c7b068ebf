"""Near copies: documents whose sets of word shingles have a Jaccard similarity of 4/5 or more.

A 64-bit fingerprint cannot decide this: at 0.8 two fingerprints differ in about ten bits,
often more.  So fingerprints only propose pairs, a second source proposes the others, and
the shingle sets decide:

1. SimHash: links of the grid join at ``radius`` bits, a spanning forest of tight groups;
2. bands of minima: a set has ``BANDS`` keys, each the least values of its shingles under
   ``ROWS`` permutations; sets of similarity s share a key with chance s**ROWS each, so a
   pair at 0.8 stays unproposed with chance (1 - 0.8**4)**32 < 5e-8, above it far less;
3. a proposed pair is linked if its sets (64-bit shingle hashes) meet the similarity.

A key's cell first proposes a star to its smallest node, and a node tests only the head that
most of its cells name.  The components of these links leave cells of several components: their
pairs are tested inside the cell, each in the first cell it shares, so no pair is ever a row.
There a pair of different components whose minima agree in fewer than ``AGREE`` of 128 places is
passed over (a pair at 0.8 agrees in fewer with chance 1e-4); the sets of what is left meet in
the cell.  A cell of many shingles is cut in chunks that meet pairwise, so a task holds at most
two chunks.  Equal sets are one node from the start.

Defined cases: wordless texts are copies of each other; fewer words than a shingle give
one shingle of all of them; null doc_ids are never the smallest of a component that has
another; rows sharing a doc_id are rows of their own; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fernloom.llm import simhash
from fernloom.llm.batches import groups, small_batches
from fernloom.llm.components import connected_components
from fernloom.scratch import materialize

#: The similarity, as a fraction, so that its test is exact.
NUM, DEN = 4, 5
BANDS, ROWS = 32, 4
#: Odd factors, each a permutation of the 64-bit hashes, and what mixes a band's minima to a key.
_FACTORS, _KEYS = (np.random.default_rng(s).integers(1, 2**63, (BANDS, ROWS), np.uint64) << np.uint64(1) | np.uint64(1) for s in (11, 12))
#: Bits of a row's key that address its cell in the map of wanted rows (8 MB whatever the table).
CELL_BITS = 26
#: Nodes a task remembers, so that it gives a copy's keys once.
SEEN = 1 << 20
PIECE = 1 << 12
#: Places of 128 in which the minima of a pair must agree, and shingles of a chunk of a cell.
AGREE, CHUNK = 86, 1 << 20


def shingles(text: str | None, size: int = 5, seed: int = 42) -> np.ndarray:
    """XXH64 of every shingle, in the text's order; words as in the fingerprints' contract."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    size = min(size, len(words))
    digest, join = xxhash.xxh64_intdigest, b" ".join
    return np.array([digest(join(words[i : i + size]), seed) for i in range(len(words) - size + 1)], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """SimHash of the shingles' hashes, as a signed long."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), simhash.BLOCK):
        ones += np.unpackbits(hashes[at : at + simhash.BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.int64)[0])


def node_of(own: np.ndarray) -> int:
    """The name of a sorted set of hashes, a signed long."""
    return int(np.array([xxhash.xxh64_intdigest(own.tobytes())], np.uint64).view(np.int64)[0])


def minima(own: np.ndarray) -> np.ndarray:
    """The least value of a set under each permutation; an empty set has the largest values."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    factors = _FACTORS.reshape(-1, 1)
    for at in range(0, len(own), PIECE):
        np.minimum(least, (own[at : at + PIECE] * factors).min(axis=1), out=least)
    return least


def bands(least: np.ndarray) -> np.ndarray:
    """The keys of a set's bands, as signed longs."""
    keys = ((least ^ least >> np.uint64(29)).reshape(BANDS, ROWS) * _KEYS).sum(axis=1, dtype=np.uint64)
    return (keys ^ keys >> np.uint64(31)).view(np.int64)


def sketch(least: np.ndarray) -> bytes:
    """One byte of each of the minima."""
    return (least >> np.uint64(24)).astype(np.uint8).tobytes()


def row_key(doc_id, text: str | None) -> int:
    """Names a row by its id and text, a signed long."""
    value = xxhash.xxh64_intdigest((text or "").encode(), xxhash.xxh64_intdigest(str(doc_id)))
    return value - (1 << 64) if value >> 63 else value


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    values = np.concatenate([np.zeros(0, np.int64), *(a.view(np.int64) for a in arrays)])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values))


def _read(docs: DataFrame, size: int) -> DataFrame:
    """``(doc_id, row, fp, node, n, sig, bands)``; repeats of a set in one task leave sig and bands null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            rows = []
            for i, t in zip(batch.column(0), batch.column(1), strict=True):
                text = t.as_py()
                every = shingles(text, size)
                own = np.unique(every)
                node = node_of(own)
                least = minima(own) if len(own) and node not in seen else None
                rows.append((row_key(i.as_py(), text), majority(every), node, len(own), *((None, None) if least is None else (sketch(least), bands(least).tolist()))))
                if len(seen) < SEEN:  # beyond it repeats are only dropped later
                    seen.add(node)
            columns = list(zip(*rows, strict=True)) or [()] * 6
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True))], ["doc_id", "row", "fp", "node", "n", "sig", "bands"])

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, row long, fp long, node long, n int, sig binary, bands array<long>")


def _sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """``(node, hashes)`` of the rows whose key is ``wanted.row`` and of a few others, from another reading of the texts."""
    word, bit = F.shiftrightunsigned("row", 64 - CELL_BITS + 6).cast("int"), F.shiftrightunsigned("row", 64 - CELL_BITS).bitwiseAND(F.lit(63)).cast("int")
    rows = wanted.groupBy(word.alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("b")).toPandas()  # at most 2**20 rows
    bits = np.zeros(1 << CELL_BITS - 6, np.uint64)
    bits[rows["w"].to_numpy(np.int64)] = rows["b"].to_numpy(np.int64).view(np.uint64)
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, seen = shared.value, set()
        for batch in batches:
            nodes, sets = [], []
            for i, t in zip(batch.column(0), batch.column(1), strict=True):
                text = t.as_py()
                at = (row_key(i.as_py(), text) & (1 << 64) - 1) >> 64 - CELL_BITS
                if not int(bits[at >> 6]) >> (at & 63) & 1:
                    continue
                own = np.unique(shingles(text, size))
                node = node_of(own)
                if node not in seen:
                    nodes.append(node)
                    sets.append(own)
                    if len(seen) < SEEN:
                        seen.add(node)
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), _lists(sets)], ["node", "hashes"])

    return docs.mapInArrow(run, "node long, hashes array<long>")


def _proved(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, size: int) -> DataFrame:
    """The pairs ``(u, v)`` whose sets have at least the similarity.

    A pair's ``v`` set moves once to its ``u``; each set of a ``u`` once.  Rows that repeat an id and
    a text give a set twice, hence the distinct.
    """
    us, vs = (_sets(docs, nodes.join(pairs.select(F.col(k).alias("node")).distinct(), "node", "left_semi"), size).select(F.col("node").alias(k), F.col("hashes").alias(f"{k}s")) for k in "uv")
    both = pairs.join(vs, "v").join(us, "u").withColumn("i", F.size(F.array_intersect("us", "vs")))
    return both.where((NUM + DEN) * F.col("i") >= NUM * (F.size("us") + F.size("vs"))).select("u", "v").distinct()


def _like(a: str, b: str):
    return DEN * F.least(a, b) >= NUM * F.greatest(a, b)


class _Cell:
    """The nodes of one part of a cell, and the pairs to be tested in it."""

    def __init__(self, rows: pa.RecordBatch):
        one = {c: rows.column(c).to_numpy(zero_copy_only=False) for c in ("cell", "chunk", "node", "n", "root")}
        self.chunk, self.node, self.n, self.root = one["chunk"], one["node"], one["n"].astype(np.int64), one["root"]
        self.sig = np.frombuffer(b"".join(rows.column("sig").to_pylist()), np.uint8).reshape(len(self.n), -1)
        self.keys = rows.column("bands").flatten().to_numpy().reshape(len(self.n), -1)
        self.band = np.argmax(self.keys[0] == one["cell"][0])
        self.across = self.chunk.min() != self.chunk.max()  # pairs inside a chunk are of the part (chunk, chunk)

    def partners(self, i: int) -> np.ndarray:
        """The later nodes that node ``i`` is tested with here."""
        j = np.arange(i + 1, len(self.n))
        small, large = np.minimum(self.n[i], self.n[j]), np.maximum(self.n[i], self.n[j])
        j = j[(self.root[j] != self.root[i]) & (DEN * small >= NUM * large) & ((self.chunk[j] != self.chunk[i]) | (not self.across))]
        j = j[(self.sig[j] == self.sig[i]).sum(axis=1) >= AGREE]
        return j[(self.keys[j] == self.keys[i]).argmax(axis=1) == self.band]


def _flag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(cell, part, chunk, node)`` of the nodes that have a pair to be tested in the part."""
    for rows in groups(batches, 2):
        own, flagged = _Cell(rows), np.zeros(rows.num_rows, bool)
        for i in range(rows.num_rows - 1):
            j = own.partners(i)
            flagged[j] = True
            flagged[i] |= len(j) > 0
        if flagged.any():
            yield rows.filter(pa.array(flagged)).select(["cell", "part", "chunk", "node"])


def _prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links ``(u, v)`` of a part that join components, from the sets of its flagged nodes."""
    for rows in groups(batches, 2):
        own, links, up = _Cell(rows), [], {}
        ends, flat = rows.column("hashes").offsets.to_numpy(), rows.column("hashes").values.to_numpy().view(np.uint64)

        def find(x, up=up):
            while x in up:
                x = up[x]
            return x

        for i in range(rows.num_rows - 1):
            mine = flat[ends[i] : ends[i + 1]]
            for k in own.partners(i).tolist():
                a, b = find(int(own.root[i])), find(int(own.root[k]))
                if a == b:
                    continue
                other = flat[ends[k] : ends[k + 1]]
                at = np.minimum(np.searchsorted(mine, other), len(mine) - 1)
                if (NUM + DEN) * int((mine[at] == other).sum()) >= NUM * (len(mine) + len(other)):
                    up[max(a, b)] = min(a, b)
                    links.append((int(own.node[i]), int(own.node[k])))
        u, v = (pa.array([x[i] for x in links], pa.int64()) for i in (0, 1))
        yield pa.RecordBatch.from_arrays([u, v], ["u", "v"])


def _between(docs: DataFrame, nodes: DataFrame, shared: DataFrame, linked: DataFrame, size: int) -> DataFrame:
    """Links between different components of ``linked`` inside the cells ``shared``."""
    named = connected_components(linked)
    members = shared.select("node").distinct().join(nodes.select("node", "row", "n", "sig", "bands"), "node").join(named, "node", "left")
    members = materialize(members.withColumn("root", F.coalesce("root", "node")), "members")
    rows = shared.select("cell", "node").join(members.select("node", "n", "root"), "node")
    split = rows.groupBy("cell").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.ceil(F.sum("n") / CHUNK).cast("int").alias("k")).where("lo < hi").select("cell", "k")
    # part (a, b) of a cell of k chunks holds chunks a and b; each row goes to k parts
    chunk = F.pmod(F.xxhash64("node"), F.col("k")).cast("int")
    dealt = rows.join(split, "cell").select("cell", "node", "k", chunk.alias("chunk"), F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("j"))
    dealt = dealt.select("cell", (F.least("chunk", "j") * F.col("k") + F.greatest("chunk", "j")).alias("part"), "chunk", "node")
    full = dealt.join(members.select("node", "n", "root", "sig", "bands"), "node").repartition("cell", "part").sortWithinPartitions("cell", "part", "node")
    columns = "cell long, part int, chunk int, node long"
    flagged = materialize(full.select("cell", "part", "chunk", "node", "n", "root", "sig", "bands").mapInArrow(_flag, columns), "flagged")
    wanted = members.join(flagged.select("node").distinct(), "node", "left_semi")
    sets = _sets(docs, wanted, size)
    full = flagged.join(members.select("node", "n", "root", "sig", "bands"), "node").join(sets, "node").repartition("cell", "part").sortWithinPartitions("cell", "part", "node")
    return full.select("cell", "part", "chunk", "node", "n", "root", "sig", "bands", "hashes").mapInArrow(_prove, "u long, v long")


def near_copies(docs: DataFrame, shingle_words: int = 5, radius: int = 4) -> DataFrame:
    """``(doc_id, component_id)`` for every row of ``docs``: the smallest doc_id reachable over links."""
    docs = small_batches(docs).select("doc_id", "text")
    read = materialize(_read(docs, shingle_words), "shingled")
    facts = [F.min("row").alias("row"), F.min("fp").alias("fp"), F.min("n").alias("n"), F.max("sig").alias("sig"), F.max("bands").alias("bands")]
    nodes = materialize(read.groupBy("node").agg(F.min("doc_id").alias("first_doc"), *facts), "nodes")

    points = materialize(nodes.groupBy("fp").agg(F.min("node").alias("head")), "points")
    ends = simhash.links(points.select("fp"), radius).select(F.col("u").alias("fp"), F.col("v").alias("other"))
    across = ends.join(points, "fp").select(F.col("head").alias("u"), F.col("other").alias("fp")).join(points, "fp").select("u", F.col("head").alias("v"))
    alike = nodes.join(points, "fp").where("node != head").select(F.col("head").alias("u"), F.col("node").alias("v"))

    dealt = nodes.select(F.explode("bands").alias("cell"), "node", "n")
    heads = dealt.groupBy("cell").agg(F.min(F.struct("node", "n")).alias("s"), F.max("node").alias("last")).where("s.node < last")
    shared = materialize(dealt.join(heads.select("cell", "s"), "cell").select("cell", "node", "n", F.col("s.node").alias("head"), F.col("s.n").alias("m")), "shared")
    votes = shared.where((F.col("node") != F.col("head")) & _like("n", "m")).groupBy("node", "head").agg(F.count("*").alias("c"))
    star = votes.groupBy("node").agg(F.max(F.struct("c", "head")).alias("s")).select(F.col("s.head").alias("u"), F.col("node").alias("v"))
    pairs = across.unionAll(alike).unionAll(star)
    pairs = materialize(pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "pairs")
    proved = materialize(_proved(docs, nodes, pairs, shingle_words), "proved")
    edges = proved.unionAll(materialize(_between(docs, nodes, shared, proved, shingle_words), "between"))

    found = nodes.join(connected_components(edges), "node", "left").select("node", "first_doc", F.coalesce("root", "node").alias("root"))
    found = materialize(found, "found")
    heads = found.groupBy("root").agg(F.min("first_doc").alias("component_id"))
    return read.select("doc_id", "node").join(found.join(heads, "root").select("node", "component_id"), "node").select("doc_id", "component_id")
