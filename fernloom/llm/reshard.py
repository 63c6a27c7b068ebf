"""Resharding by minimum-cost flow.

Old shards have sizes, new shards have capacities.  A flow network with cost 0 for bytes
that stay and 1 for bytes that move is solved exactly; its optimum is the fewest bytes
any plan moves.  The flow is then carried out by blocks: each old shard is a set of hash
blocks (equal texts share a block), and whole blocks go where the flow sends bytes.

A stored shard's files lie by part, a range of its blocks (``shard=k/part=p``).  Of each old
shard only the parts that give the flow's bytes are affected: only their blocks may move and
only their files are read and written anew; all other files stay and serve the new shards.

Sizes are measured per block by one aggregation, so the driver holds one row per block
(a parameter), never one per document.  A heavy block is cut by a second hash of the
text; only a group of copies of more than half a new shard is split by doc_id hash.

Map tasks write their own rows: texts are never shuffled.  A slot is the row's place in
its shard's files, so numbering needs file row counts only.

Defined cases: a null text counts one byte (its terminator) and has the checksum of the
empty text; equal texts land in one shard unless their group is heavier than half a
shard; a null doc_id is dealt like any other; columns besides id and text are not written;
an empty table gives an empty result; fewer rows than shards leaves some empty.
"""

from __future__ import annotations

from bisect import insort
from dataclasses import dataclass
from heapq import heappop, heappush

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fernloom.scratch import scratch_path


def min_cost_flow(supply: list[int], capacity: list[int], cost: list[list[int]]) -> list[list[int]]:
    """Cheapest flow of all supply into the capacities (successive shortest paths with potentials)."""
    n, m = len(supply), len(capacity)
    if sum(supply) > sum(capacity):
        raise ValueError("capacities are below the supply")
    source, sink = n + m, n + m + 1
    graph: list[list[list[int]]] = [[] for _ in range(n + m + 2)]

    def edge(a: int, b: int, cap: int, price: int) -> None:
        graph[a].append([b, cap, price, len(graph[b])])
        graph[b].append([a, 0, -price, len(graph[a]) - 1])

    for i, s in enumerate(supply):
        edge(source, i, s, 0)
        for j in range(m):
            edge(i, n + j, s, cost[i][j])
    for j, c in enumerate(capacity):
        edge(n + j, sink, c, 0)
    potential = [0] * (n + m + 2)  # prices are not negative
    while True:
        far, came = [None] * (n + m + 2), [None] * (n + m + 2)
        far[source], heap = 0, [(0, source)]
        while heap:
            d, a = heappop(heap)
            if d > far[a]:
                continue
            for k, (b, cap, price, _) in enumerate(graph[a]):
                if cap and (far[b] is None or d + price + potential[a] - potential[b] < far[b]):
                    far[b] = d + price + potential[a] - potential[b]
                    came[b] = (a, k)
                    heappush(heap, (far[b], b))
        if far[sink] is None:
            break
        potential = [p + (d or 0) for p, d in zip(potential, far, strict=True)]
        push, b = None, sink
        while b != source:
            a, k = came[b]
            push = graph[a][k][1] if push is None else min(push, graph[a][k][1])
            b = a
        b = sink
        while b != source:
            a, k = came[b]
            graph[a][k][1] -= push
            graph[b][graph[a][k][3]][1] += push
            b = a
    flow = [[0] * m for _ in range(n)]
    for i in range(n):
        for b, _, _, back in graph[i]:
            if n <= b < n + m:
                flow[i][b - n] = graph[b][back][1]
    return flow


def even_capacity(total: int, shards: int) -> list[int]:
    return [total // shards + (j < total % shards) for j in range(shards)]


def place_blocks(blocks: list[tuple], capacity: list[int], cost: list[list[int]] | None = None) -> dict[tuple, int]:
    """New shard of each block ``(old_shard, ..., size)``: the flow's quotas, largest block first, then fine levelling."""
    old = sorted({b[0] for b in blocks})
    row = {o: i for i, o in enumerate(old)}
    supply = [sum(b[-1] for b in blocks if b[0] == o) for o in old]
    shards = len(capacity)
    flow = min_cost_flow(supply, capacity, cost or [[int(o != j) for j in range(shards)] for o in old])
    load, where = [0] * shards, {}
    for b in sorted(blocks, key=lambda b: (-b[-1], b[:-1])):
        quota = flow[row[b[0]]]
        j = max(range(shards), key=lambda j: (quota[j], j == b[0], -j))
        quota[j] -= b[-1]
        load[j] += b[-1]
        where[b[:-1]] = j
    inside = [sorted((b[-1], b[:-1]) for b in blocks if where[b[:-1]] == j) for j in range(shards)]
    nothing = [(0, None)]  # a swap with nothing is a move
    for _ in range(4 * len(blocks)):  # what whole blocks left uneven
        gaps = [x - c for x, c in zip(load, capacity, strict=True)]
        high, low = max(range(shards), key=gaps.__getitem__), min(range(shards), key=gaps.__getitem__)
        gap = gaps[high] - gaps[low]
        at_home = [x for x in inside[high] if x[1][0] == high]
        guests = [x for x in inside[high] if x[1][0] != high]
        ours = [x for x in inside[low] if x[1][0] == high]
        others = nothing + [x for x in inside[low] if x[1][0] != low]
        # first what moves no byte more than the gap, then anything while the gap is over half a per cent
        choices = [(at_home, ours), (guests, others)]
        swaps = [(x[0], h[x[1]], w[x[2]]) for h, w in choices if (x := best_swap(h, w, gap))]
        if not swaps and gap * 200 > max(capacity):
            h, w = nothing + inside[high], nothing + inside[low]
            swaps = [(x[0], h[x[1]], w[x[2]]) for _ in (0,) if (x := best_swap(h, w, gap))]
        if not swaps:
            break
        _, give, take = min(swaps, key=lambda x: (x[0], str(x[1:])))
        for shard, out, into in ((high, give, take), (low, take, give)):
            if out[1] is not None:
                inside[shard].remove(out)
            if into[1] is not None:
                insort(inside[shard], into)
                where[into[1]] = shard
            load[shard] += into[0] - out[0]
    send_home(inside, load, capacity, where)
    return where


def send_home(inside: list[list[tuple]], load: list[int], capacity: list[int], where: dict[tuple, int]) -> None:
    """Exchange blocks that levelling moved for others of like size, or nothing, where no gap grows beyond the largest there is."""
    shards = range(len(load))
    worst = max((abs(x - c) for x, c in zip(load, capacity, strict=True)), default=0)
    changed = True
    while changed:  # every exchange lowers the moved bytes, so this ends
        changed = False
        for j in shards:
            for a in sorted((x for x in inside[j] if x[1][0] != j and x[1][0] in shards), reverse=True):
                h = a[1][0]
                others = [x for x in inside[h] if x[1][0] != h]
                fits = []
                for b in [(0, None), *others]:
                    d = a[0] - b[0]
                    if abs(load[j] - d - capacity[j]) <= worst and abs(load[h] + d - capacity[h]) <= worst:
                        fits.append((-b[0] if b[1] and b[1][0] == j else 0, abs(d), str(b[1]), b))
                if not fits:
                    continue
                b = min(fits)[3]
                for shard, out, into in ((j, a, b), (h, b, a)):
                    if out[1] is not None:
                        inside[shard].remove(out)
                    if into[1] is not None:
                        insort(inside[shard], into)
                        where[into[1]] = shard
                    load[shard] += into[0] - out[0]
                changed = True


def best_swap(high: list[tuple], low: list[tuple], gap: int) -> tuple[float, int, int] | None:
    """(miss, place, place) of the blocks (sorted by size) whose exchange best halves a gap; None if none narrows it."""
    if not high or not low:
        return None
    h, w = np.array([x[0] for x in high]), np.array([x[0] for x in low])
    at = np.searchsorted(w, h - gap / 2)
    best = None
    for near in (np.clip(at - 1, 0, len(w) - 1), np.clip(at, 0, len(w) - 1)):
        miss = np.abs(h - w[near] - gap / 2)
        i = int(miss.argmin())
        if miss[i] < gap / 2 and (best is None or miss[i] < best[0]):
            best = (float(miss[i]), i, int(near[i]))
    return best


def text_size(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def text_crc32(text: Column) -> Column:
    return F.crc32(F.encode(F.coalesce(text, F.lit("")), "UTF-8"))


#: Blocks and parts of a stored shard, the share (one in ``HEAVY``) beyond which a block is cut, and its cuts.
BLOCKS, PARTS, HEAVY, CUTS = 512, 4, 128, 256


def store(docs: DataFrame, shard: Column, path: str) -> DataFrame:
    """Write ``(doc_id, text)`` as shards: files by shard and part, with each row's size and block."""
    rows = docs.select("doc_id", "text", text_size(F.col("text")).alias("size"), F.pmod(F.xxhash64("text"), F.lit(BLOCKS)).cast("int").alias("block"), shard.cast("int").alias("shard"))
    rows.withColumn("part", F.floor(F.col("block") * PARTS / BLOCKS).cast("int")).write.partitionBy("shard", "part").parquet(path)
    return docs.sparkSession.read.schema(f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text string, size long, block int, shard int, part int").parquet(path)


@dataclass
class Plan:
    """Which parts of the stored shards are affected, and the new shard of every block in them."""

    affected: list[tuple[int, int]]
    where: dict[tuple, int]
    heavy: list[tuple]
    hot: dict[tuple, int]
    moved_bytes: int
    fewest_bytes: int


AT = ["shard", "block", "sub", "cut"]


def _parts_for(sizes: dict[int, int], need: int) -> list[int]:
    """Parts of at least ``need`` bytes together: the largest until one more suffices, then the smallest that does."""
    chosen, have = [], 0
    left = sorted(sizes, key=lambda p: (-sizes[p], p))
    while have < need:
        enough = [p for p in left if have + sizes[p] >= need]
        chosen.append(enough[-1] if enough else left[0])
        left.remove(chosen[-1])
        have += sizes[chosen[-1]]
    return chosen


def plan(stored: DataFrame, shards: int) -> Plan:
    """Transfers of whole blocks that make ``shards`` shards of equal bytes.  The driver holds one row per block.

    A block over ``1/HEAVY`` of all bytes or rows is cut in ``CUTS`` by a second hash of
    the text.  A cut of more than half a new shard is one group of copies, which equal
    sizes cannot keep whole; it is cut by doc_id.
    """
    sizes, total, rows = _sizes(stored, AT[:2])
    heavy = [k for k, (s, n) in sizes.items() if s * HEAVY > total or n * HEAVY > rows]
    inner = _sizes(_cut_heavy(stored, heavy).where("sub IS NOT NULL"), AT[:3])[0] if heavy else {}
    hot = {k: 2 * (s * HEAVY // max(total, 1)) + 2 for k, (s, _) in inner.items() if s * 2 * shards > total}
    last = _sizes(_cut_hot(_cut_heavy(stored, heavy), hot).where("cut IS NOT NULL"), AT)[0] if hot else {}
    gone = set(heavy)
    whole = {(*k, 0, 0): s for k, (s, _) in sizes.items() if k not in gone} | {(*k, 0): s for k, (s, _) in inner.items() if k not in hot} | {k: s for k, (s, _) in last.items()}

    capacity = even_capacity(total, shards)
    old = sorted({k[0] for k in whole})
    supply = [sum(s for k, s in whole.items() if k[0] == o) for o in old]
    flow = min_cost_flow(supply, capacity, [[int(o != j) for j in range(shards)] for o in old])
    leaving = [sum(f for j, f in enumerate(own) if j != o) for o, own in zip(old, flow, strict=True)]
    affected = []
    for o, need in zip(old, leaving, strict=True):
        by_part: dict[int, int] = {}
        for k, s in whole.items():
            if k[0] == o:
                by_part[k[1] * PARTS // BLOCKS] = by_part.get(k[1] * PARTS // BLOCKS, 0) + s
        affected += [(o, p) for p in _parts_for(by_part, need)]
    touched = {k: s for k, s in whole.items() if (k[0], k[1] * PARTS // BLOCKS) in set(affected)}
    fixed = [sum(s for k, s in whole.items() if k[0] == j and k not in touched) for j in range(shards)]
    where = place_blocks([(*k, s) for k, s in touched.items()], [c - f for c, f in zip(capacity, fixed, strict=True)]) if touched else {}
    return Plan(affected, where, heavy, hot, sum(s for k, s in touched.items() if where[k] != k[0]), sum(leaving))


def _sizes(rows: DataFrame, by: list[str]) -> tuple[dict, int, int]:
    """Bytes and rows by block, and in all; one row per block reaches the driver."""
    got = {tuple(r[c] for c in by): (r["s"], r["n"]) for r in rows.groupBy(*by).agg(F.sum("size").alias("s"), F.count("*").alias("n")).collect()}
    return got, sum(s for s, _ in got.values()), sum(n for _, n in got.values())


def _marked(rows: DataFrame, listed: list[tuple], by: list[str]) -> DataFrame:
    """``k`` on the rows of the listed blocks; the list has at most 2 x HEAVY rows."""
    table = rows.sparkSession.createDataFrame(listed, ", ".join(f"{c} int" for c in by) + ", k int")
    return rows.join(F.broadcast(table), by, "left")


def _cut_heavy(rows: DataFrame, heavy: list[tuple]) -> DataFrame:
    """``sub``: a second hash of the text in heavy blocks, else null."""
    marked = _marked(rows, [(*k, 1) for k in heavy], AT[:2])
    return marked.withColumn("sub", F.when(F.col("k").isNotNull(), F.pmod(F.xxhash64("text", F.lit("sub")), F.lit(CUTS)).cast("int"))).drop("k")


def _cut_hot(rows: DataFrame, hot: dict[tuple, int]) -> DataFrame:
    """``cut``: a hash of the doc_id in the cuts that are too heavy for a shard, else null."""
    marked = _marked(rows, [(*k, v) for k, v in hot.items()], AT[:3])
    return marked.withColumn("cut", F.pmod(F.xxhash64(F.struct("doc_id")), F.col("k")).cast("int")).drop("k")


def rewrite(stored: DataFrame, planned: Plan, path: str) -> tuple[DataFrame, DataFrame]:
    """The files that stay, and the affected parts' rows written anew under ``path``; together the new shards.

    Both have ``(doc_id, text, size, old_shard, shard)``.  The old files of affected parts are left alone, so a
    reader of the old shards goes on, and a job that dies half way has changed nothing.
    """
    spark = stored.sparkSession
    hit = F.lit(False)
    for o in sorted({o for o, _ in planned.affected}):  # one term a shard
        hit |= (F.col("shard") == o) & F.col("part").isin([p for x, p in planned.affected if x == o])
    stay = stored.where(~hit).select("doc_id", "text", "size", F.col("shard").alias("old_shard"), "shard", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    keyed = _cut_hot(_cut_heavy(stored.where(hit), planned.heavy), planned.hot).withColumns({"sub": F.coalesce("sub", F.lit(0)), "cut": F.coalesce("cut", F.lit(0))})
    moves = spark.createDataFrame([(*k, j) for k, j in planned.where.items()], "shard int, block int, sub int, cut int, new_shard int")
    moved = keyed.join(F.broadcast(moves), AT).select("doc_id", "text", "size", F.col("shard").alias("old_shard"), F.col("new_shard").alias("shard"))
    moved.write.partitionBy("shard").parquet(path)
    fresh = spark.read.schema(", ".join(f"{f.name} {f.dataType.simpleString()}" for f in moved.schema)).parquet(path)
    return stay, fresh.select(*moved.columns, F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))


def with_slots(shards: DataFrame, **columns: Column) -> DataFrame:
    """``columns`` and ``shard`` of the rows of ``reshard`` plus ``slot``, a row's place in its shard by file and row in file.

    The columns are worked out at the scan, so only they meet the files' offsets.
    """
    at = shards.select("shard", "file", "row", *[c.alias(n) for n, c in columns.items()])
    files = at.groupBy("shard", "file").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    offsets = files.select("shard", "file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return at.join(offsets, ["shard", "file"]).select(*columns, "shard", (F.col("before") + F.col("row")).cast("long").alias("slot"))


def reshard(stored: DataFrame, shards: int, path: str | None = None) -> tuple[DataFrame, Plan]:
    """Plan and rewrite shards of ``store``: ``(doc_id, text, size, old_shard, shard, file, row)`` of all rows, and the plan."""
    planned = plan(stored, shards)
    stay, fresh = rewrite(stored, planned, path or scratch_path(stored.sparkSession, "shards"))
    return stay.unionByName(fresh), planned


def op3_min_cost_flow_reshard(spark: SparkSession, sf_dir: str, old_shards: int = 6, shards: int = 8) -> DataFrame:
    """Contract query: six stored hash shards of ``documents`` become eight of near equal bytes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    stored = store(docs, F.pmod(text_crc32(F.col("text")), F.lit(old_shards)), scratch_path(spark, "old-shards"))
    made, planned = reshard(stored, shards)
    out = with_slots(made, doc_id=F.col("doc_id"), size=F.col("size"), text_crc32=text_crc32(F.col("text")), old_shard=F.col("old_shard"))
    ends = {"moved_bytes": planned.moved_bytes, "fewest_bytes": planned.fewest_bytes}
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard", *[F.lit(v).cast("long").alias(k) for k, v in ends.items()])
