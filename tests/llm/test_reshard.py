import random
import zlib
from itertools import permutations, product

from pyspark.sql import functions as F

from fernloom.llm import reshard
from tests.llm.util import TEXTS, documents


def test_flow_is_cheapest():
    flow = reshard.min_cost_flow([5, 7], [4, 4, 4], [[0, 1, 1], [1, 0, 1]])
    assert [sum(r) for r in flow] == [5, 7] and [sum(c) for c in zip(*flow, strict=True)] == [4, 4, 4]
    assert 12 - flow[0][0] - flow[1][1] == 4
    cost = [[3, 1, 4], [1, 5, 9], [2, 6, 5]]
    best = min(sum(cost[i][p[i]] for i in range(3)) for p in permutations(range(3)))
    one = reshard.min_cost_flow([1, 1, 1], [1, 1, 1], cost)
    assert sum(cost[i][j] * one[i][j] for i in range(3) for j in range(3)) == best


def test_blocks_move_no_more_than_needed():
    blocks = [(o, b, 0, 100 + b % 7) for o in range(6) for b in range(400)]
    where = reshard.place_blocks(blocks, reshard.even_capacity(sum(b[-1] for b in blocks), 8))
    load = [sum(b[-1] for b in blocks if where[b[:-1]] == j) for j in range(8)]
    moved = sum(b[-1] for b in blocks if where[b[:-1]] != b[0])
    assert max(load) - min(load) <= sum(load) / 8 / 200
    fewest = sum(max(0, sum(b[-1] for b in blocks if b[0] == o) - sum(load) // 8) for o in range(6))
    assert moved <= 1.02 * fewest


def test_flow_against_every_plan():
    """Each unit's shard by exhaustive search: no assignment within the capacities moves fewer units."""
    for supply, capacity in (([4, 3], [3, 2, 2]), ([5, 1, 1], [3, 2, 2]), ([3, 4], [2, 3, 2]), ([7], [3, 2, 2])):
        units = [o for o, n in enumerate(supply) for _ in range(n)]
        fits = [x for x in product(range(len(capacity)), repeat=len(units)) if all(x.count(j) <= c for j, c in enumerate(capacity))]
        fewest = min(sum(o != j for o, j in zip(units, x, strict=True)) for x in fits)
        flow = reshard.min_cost_flow(supply, capacity, [[int(o != j) for j in range(len(capacity))] for o in range(len(supply))])
        assert sum(f for o, row in enumerate(flow) for j, f in enumerate(row) if j != o) == fewest


def test_few_coarse_blocks_are_placed_as_evenly_as_any_plan():
    """Eight coarse blocks against exhaustive search.  Only evenness is claimed for so few: moved bytes came out up to twice the fewest."""
    for seed in range(6):
        rng = random.Random(seed)
        blocks = [(o, b, 0, rng.randint(5, 9)) for o in range(2) for b in range(4)]
        capacity = reshard.even_capacity(sum(b[-1] for b in blocks), 3)

        def miss(shards, blocks=blocks, capacity=capacity):
            load = [sum(b[-1] for b, j in zip(blocks, shards, strict=True) if j == k) for k in range(3)]
            return max(abs(x - c) for x, c in zip(load, capacity, strict=True))

        where = reshard.place_blocks(blocks, capacity)
        assert miss([where[b[:-1]] for b in blocks]) <= max(3, min(map(miss, product(range(3), repeat=len(blocks)))))


def stored(spark, df, tmp, shards=6):
    return reshard.store(df.select("doc_id", "text"), F.pmod(reshard.text_crc32(F.col("text")), F.lit(shards)), str(tmp / "old"))


def test_reshard_is_whole_even_and_gapless(spark, tmp_path):
    texts = [*TEXTS[:5], *(f"document {i % 400} " * (1 + i % 5) for i in range(900)), *["hot copy"] * 600, *[""] * 300]
    df = documents(spark, texts)
    made, planned = reshard.reshard(stored(spark, df, tmp_path), 8)
    out = reshard.with_slots(made, doc_id=F.col("doc_id"), text=F.col("text"), old=F.col("old_shard")).collect()
    assert all(r.old == zlib.crc32((r.text or "").encode()) % 6 for r in out)
    assert planned.moved_bytes == sum(len((r.text or "").encode()) + 1 for r in out if r.shard != r.old)
    assert planned.fewest_bytes <= planned.moved_bytes <= 1.1 * planned.fewest_bytes
    assert sorted(r.doc_id for r in out) == list(range(len(texts)))
    assert {r.doc_id: r.text for r in out} == dict(enumerate(texts))
    for s in range(8):
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out)))
    load = [sum(len((r.text or "").encode()) + 1 for r in out if r.shard == s) for s in range(8)]
    assert max(load) - min(load) <= 0.02 * sum(load) / 8
    cool = {}
    for r in out:
        if r.text not in ("hot copy", ""):
            cool.setdefault(r.text, set()).add(r.shard)
    assert all(len(s) == 1 for s in cool.values())
    assert len({r.shard for r in out if r.text == "hot copy"}) > 1  # more bytes than half a shard
    assert len({r.shard for r in out if r.text == ""}) == 1  # many rows, few bytes


def test_a_group_of_a_third_of_all_bytes_is_split(spark, tmp_path):
    texts = [*(f"document {i} " * (1 + i % 5) for i in range(600)), *["copy of many words " * 4] * 200, *["light copy"] * 60]
    df = documents(spark, texts)
    out = reshard.reshard(stored(spark, df, tmp_path), 8)[0].collect()
    assert sorted(r.doc_id for r in out) == list(range(len(texts)))
    load = [sum(len(r.text.encode()) + 1 for r in out if r.shard == s) for s in range(8)]
    assert max(load) - min(load) <= 0.02 * sum(load) / 8
    assert len({r.shard for r in out if r.text.startswith("copy")}) > 1 and len({r.shard for r in out if r.text == "light copy"}) == 1


def test_only_affected_files_are_rewritten(spark, tmp_path):
    df = documents(spark, [f"document {i} " * (1 + i % 5) for i in range(3000)])
    old = stored(spark, df, tmp_path)
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "old").rglob("*.parquet")}
    made, planned = reshard.reshard(old, 8, str(tmp_path / "new"))
    rows = made.select("doc_id", "file", "shard", "old_shard").collect()
    assert sorted(r.doc_id for r in rows) == list(range(3000))
    kept = {"/" + r.file.removeprefix("file:").lstrip("/") for r in rows if "/old/" in r.file}
    affected = {f"shard={o}/part={p}" for o, p in planned.affected}
    assert len(affected) < 6 * reshard.PARTS / 2  # most parts stay as they are
    assert kept == {str(p) for p in before if not any(a in str(p) for a in affected)}
    assert all(r.shard == r.old_shard for r in rows if "/old/" in r.file)
    assert {p: p.stat().st_mtime_ns for p in (tmp_path / "old").rglob("*.parquet")} == before


def test_nulls_repeats_and_empty(spark, tmp_path):
    df = spark.createDataFrame([(None, None), (None, None), (1, "x"), (1, "x"), (2, "y" * 100_000)], "doc_id long, text string")
    sized = df.select(reshard.text_size(F.col("text")).alias("s"), reshard.text_crc32(F.col("text")).alias("c")).collect()
    assert [(r.s, r.c) for r in sized][:3] == [(1, 0), (1, 0), (2, zlib.crc32(b"x"))]
    assert reshard.reshard(reshard.store(df, F.lit(0), str(tmp_path / "a")), 8)[0].count() == 5
    assert reshard.reshard(reshard.store(df.limit(0), F.lit(0), str(tmp_path / "b")), 8)[0].count() == 0
