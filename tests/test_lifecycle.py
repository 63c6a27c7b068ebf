"""The lifecycle of postings: rules, groups against single postings, stream against batch with late readings."""

import datetime as dt
import random

import pytest

from fernloom.operators import lifecycle as queries
from fernloom.registry import Tables
from fernloom.streaming import lifecycle as lc

DAY = 86400.0
SCHEMA = "ats string, board string, reading_ts timestamp, kind string, listed array<string>"


def plain(readings):
    """One board, every posting on its own: ``({posting: state}, [result], [confirm])``."""
    board, postings, results, confirms = {"at": None, "held": 0, "since": None, "empty": 0, "yielded": None}, {}, [], []

    def ask(upto):
        due = {}
        for p in postings.values():
            if p["closed"] is None and p["miss"] == 1 and not p["asked"] and p["first"] + 7200 <= upto:
                due[p["first"] + 7200] = due.get(p["first"] + 7200, 0) + 1
                p["asked"] = True
        confirms.extend(sorted(due.items()))

    def close(p, at, reason):
        p["closed"], p["reason"] = at, reason

    for at, kind, listed in sorted(readings, key=lambda r: r[0]):
        if board["at"] is not None and at <= board["at"]:
            continue
        ask(at - 1e-6)
        board["at"] = at
        open_now = {k: p for k, p in postings.items() if p["closed"] is None}
        result = {"at": at, "open": len(open_now), "missing": 0, "newly": 0, "closed": 0, "held": False}
        results.append(result)
        if kind == "failed":
            continue
        if kind == "empty":
            board["empty"] += 1
            if board["empty"] >= 3 and board["yielded"] is not None and at - board["yielded"] >= 7 * DAY:
                for p in open_now.values():
                    close(p, at, "board_empty")
                result["closed"] = len(open_now)
            continue
        board["empty"], board["yielded"] = 0, at
        seen = set(listed) if kind == "listing" else {k for k, p in open_now.items() if not p["miss"]}
        missing = [p for k, p in open_now.items() if k not in seen]
        for k in seen:
            postings[k] = {"miss": 0, "first": None, "seen": at, "closed": None, "reason": None, "asked": False}
        fresh = sum(not p["miss"] for p in missing)
        result |= {"missing": len(missing), "newly": fresh}
        if len(open_now) >= 10 and fresh > 0.5 * len(open_now):
            board["held"] += 1
            board["since"] = at if board["since"] is None else board["since"]
            result["held"] = True
            if board["held"] >= 3 and at - board["since"] >= DAY:
                result |= {"held": False, "closed": len(missing)}
                for p in missing:
                    close(p, at, "mass_close")
                board["held"], board["since"] = 0, None
            continue
        board["held"], board["since"] = 0, None
        for p in missing:
            p["miss"] += 1
            p["first"] = at if p["first"] is None else p["first"]
            if p["miss"] >= 2 and (at - p["first"] >= 7200 or at - p["seen"] >= 48 * 3600):
                close(p, at, "missing")
                result["closed"] += 1
    ask(float("inf"))
    return postings, results, confirms


def test_rules():
    def p(*readings):
        return plain(readings)[0]

    assert p((0, "listing", ["a", "b"]), (100, "listing", ["a"]), (200, "listing", ["a"]))["b"]["closed"] is None  # second miss too soon
    q = p((0, "listing", ["a", "b"]), (100, "listing", ["a"]), (7400, "not_modified", []))
    assert q["b"]["reason"] == "missing" and q["a"]["seen"] == 7400
    q = p((0, "listing", ["a"]), (100, "listing", ["b"]), (200, "listing", ["a"]))
    assert q["a"]["miss"] == 0 and q["a"]["closed"] is None
    many = [str(i) for i in range(12)]
    q = p((0, "listing", many), (100, "listing", ["0"]), (DAY, "listing", ["0"]), (DAY + 50, "listing", ["0"]))
    assert all(x["closed"] is None for x in q.values())
    q = p((0, "listing", many), (100, "listing", ["0"]), (DAY, "listing", ["0"]), (DAY + 200, "listing", ["0"]))
    assert sum(x["reason"] == "mass_close" for x in q.values()) == 11
    assert p((0, "listing", ["a"]), (1, "empty", []), (2, "empty", []), (3, "empty", []))["a"]["closed"] is None
    assert p((0, "listing", ["a"]), (1, "empty", []), (2, "empty", []), (8 * DAY, "empty", []))["a"]["reason"] == "board_empty"


def log(seed, boards="wxyz", readings=24):
    rng, rows = random.Random(seed), []
    for board in boards:
        size = rng.choice([6, 15, 40])
        at = dt.datetime(2024, 1, 1)
        for _ in range(readings):
            at += dt.timedelta(minutes=rng.choice([20, 60, 130, 600, 1500, 5000]))
            kind = rng.choice(["listing"] * 6 + ["not_modified", "empty", "empty", "failed"])
            share = rng.choice([0.9, 0.9, 0.7, 0.3])
            rows.append(("ats", board, at, kind, [f"p{i}" for i in range(size) if rng.random() < share] if kind == "listing" else None))
    return rows


def seconds(ts):
    return None if ts is None else ts.replace(tzinfo=dt.UTC).timestamp()


def wanted(rows):
    """What ``plain`` says of every board."""
    states, results, confirms = {}, set(), set()
    for board in {r[1] for r in rows}:
        p, log_, asked = plain([(seconds(r[2]), r[3], r[4] or []) for r in rows if r[1] == board])
        states |= {(board, k): (x["miss"], x["seen"], x["closed"], x["reason"]) for k, x in p.items()}
        results |= {(board, *x.values()) for x in log_}
        confirms |= {(board, at, n) for at, n in asked}
    return states, results, confirms


def states_of(df):
    return {(r.board, r.posting): (r.miss_count, seconds(r.last_seen), seconds(r.closed_at), r.closed_reason) for r in df.collect()}


def told_of(rows):
    results = {(r.board, seconds(r.at), r.open, r.missing, r.newly, r.closed, r.held) for r in rows if r.what == "reading"}
    return results, {(r.board, seconds(r.at), r.n) for r in rows if r.what == "confirm"}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_groups_equal_single_postings(spark, seed):
    rows = log(seed)
    rng = random.Random(seed)
    rows += [rows[3], rows[7]]  # repeated readings
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA)
    states, results, confirms = wanted(rows)
    assert states_of(lc.settle(df)) == states
    assert told_of(lc.told(df).collect()) == (results, confirms)


def test_stream_equals_batch_on_late_readings(spark, tmp_path):
    rows = log(5, boards="xyz", readings=16)
    rows.sort(key=lambda r: r[2])
    late = [r for i, r in enumerate(rows) if i % 4 == 1]  # these come a file later, out of order
    rest = [r for i, r in enumerate(rows) if i % 4 != 1]
    cut = len(rest) // 3
    ends = [rest[cut - 1][2], rest[2 * cut - 1][2]]
    parts = [rest[:cut], rest[cut : 2 * cut] + [r for r in late if r[2] <= ends[0]], rest[2 * cut :] + [r for r in late if r[2] > ends[0]]]
    marker = ("ats", "end", rows[-1][2] + dt.timedelta(days=400), "failed", None)
    source = str(tmp_path / "in")
    for k, part in enumerate([*parts, [marker], [(*marker[:2], marker[2] + dt.timedelta(days=400), *marker[3:])]]):
        random.Random(k).shuffle(part)
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(source)
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = lc.told_stream(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source), late="60 days", shards=3)
        q = stream.writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(240)
        assert q.exception() is None
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
    told = spark.read.parquet(str(tmp_path / "out"))
    states, results, confirms = wanted(rows)
    assert states_of(lc.postings_of(lc.listings(spark.createDataFrame(rows, SCHEMA)), told)) == states
    assert told_of(told.where("board <> 'end'").collect()) == (results, confirms)


def test_the_fold_reads_few_rows_of_a_large_board(spark):
    n = 200_000
    big = spark.range(n).selectExpr("concat('p', id) AS p", "id")
    readings = big.selectExpr("explode(array(1, 2, 3)) AS day", "p", "id").where("day = 1 OR id % 10 <> day").groupBy("day").agg({"p": "collect_list"})
    readings = readings.selectExpr("'ats' AS ats", "'b' AS board", "timestamp_seconds(day * 86400) AS reading_ts", "'listing' AS kind", "`collect_list(p)` AS listed")
    assert lc.moves(lc.listings(readings)).count() <= 6
    out = lc.settle(readings).groupBy("miss_count", "closed_reason").count().collect()
    assert {(r.miss_count, r.closed_reason): r["count"] for r in out} == {(0, None): n - n // 10, (1, None): n // 10}


def test_registered_readings_equal_the_plain_rules(spark, sf):
    rows = [tuple(r) for r in queries.readings(Tables(spark, sf)).select("ats", "board", "reading_ts", "kind", "listed").collect()]
    states, results, confirms = wanted(rows)
    assert states_of(queries.st_reading(Tables(spark, sf))) == states
    assert {r[3] for r in rows} == {"listing", "not_modified", "empty", "failed"} and results and confirms
