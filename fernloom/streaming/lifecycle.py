"""Posting lifecycle from complete board readings, as a batch and as a stream, spread by posting.

A reading is ``(ats, board, reading_ts, kind, listed)`` with kind one of listing,
not_modified, empty, failed.  Per posting: a miss counts up while readings omit it; it
closes at the second miss two hours or more after the first, or 48 hours after it was last
seen.  A listing that would drop more than half of ten or more open postings is held until
three such readings span a day.  An empty board closes after three empty readings and a
week of silence.  Readings not newer than the state are ignored.  Two hours after a first miss a
confirming reading is asked for, unless the posting was seen or missed again by then.

All postings that the same reading listed last have the same state: it follows from that
reading's time and the board's later readings.  So the work falls into two parts.  By posting,
and spread as such: which reading listed it before (*moves* of postings from one group to the
next).  By board: a fold over few rows, the sizes of moves and the states of groups.  A board of a
million postings is a million rows of the first part and no more rows of the second.

The stream has the same two parts, each a ``transformWithState``: the first keeps each posting's
last listing in a map state, a board dealt over ``shards`` keys, and a timer at each reading's time
puts late readings in order; the second keeps groups in a map state, with timers for the confirming
reading and for the expiry of closed groups.

Defined cases: readings of one board at one time are one reading (their lists together, the kind
that says most); a null list is empty; postings listed by no listing are no rows; an empty log
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window

OUT = "ats string, board string, posting string, miss_count int, last_seen timestamp, closed_at timestamp, closed_reason string"
#: What the fold tells: states of groups, results of readings, confirming readings asked for.
TOLD = "ats string, board string, at long, what string, listed_at long, n long, miss_count int, last_seen long, closed_at long, closed_reason string, open long, missing long, newly long, closed long, held boolean"
#: Its columns that are times: microseconds in Python, where no time zone can shift them.
TIMES = ["at", "listed_at", "last_seen", "closed_at"]
#: Seconds of the rules above, and the mass-close guard.
CONFIRM_GAP, GRACE, HOLD_SPAN, SILENCE = 2 * 3600, 48 * 3600, 24 * 3600, 7 * 24 * 3600
HOLD_SHARE, HOLD_LEAST, HOLD_READINGS, EMPTY_READINGS = 0.5, 10, 3, 3
#: Seconds after which the stream forgets a closed group.
EXPIRY = 90 * 24 * 3600
#: Of two kinds at one time, the one that says more.
SAYS = ["failed", "empty", "not_modified", "listing"]


def new_board() -> dict:
    """A board without readings; ``groups``: postings by the reading that listed them last."""
    return {"at": None, "held": 0, "held_since": None, "empty": 0, "yielded": None, "groups": {}}


def confirmations(state: dict, upto: float) -> list[dict]:
    """Confirming readings that fall due by ``upto``, once each."""
    due: dict[float, int] = {}
    for g in state["groups"].values():
        if g["closed"] is None and g["miss"] == 1 and not g["asked"] and g["first"] + CONFIRM_GAP <= upto:
            due[g["first"]] = due.get(g["first"], 0) + g["n"]
            g["asked"] = True
    return [{"at": f + CONFIRM_GAP, "what": "confirm", "n": n} for f, n in sorted(due.items())]


def apply_reading(state: dict, at: float, kind: str, moved: dict[float | None, int]) -> dict | None:
    """One reading into a board's state, and its result; times are seconds since the epoch.

    ``moved`` has the sizes of what the reading lists, by the reading that listed it before (None: none did).
    """
    if state["at"] is not None and at <= state["at"]:
        return None
    state["at"] = at
    groups = state["groups"]
    open_now = [g for g in groups.values() if g["closed"] is None]
    result = {"at": at, "what": "reading", "open": sum(g["n"] for g in open_now), "missing": 0, "newly": 0, "closed": 0, "held": False}

    def close(group: dict, reason: str) -> None:
        group["closed"], group["reason"] = at, reason
        result["closed"] += group["n"]

    if kind == "failed":
        return result
    if kind == "empty":
        state["empty"] += 1
        if state["empty"] >= EMPTY_READINGS and state["yielded"] is not None and at - state["yielded"] >= SILENCE:
            for g in open_now:
                close(g, "board_empty")
        return result
    state["empty"], state["yielded"] = 0, at
    if kind == "listing":
        for s, n in moved.items():
            if s in groups:
                groups[s]["n"] -= n
        for s in [s for s, g in groups.items() if g["n"] <= 0]:
            del groups[s]
        missing = [g for g in groups.values() if g["closed"] is None]
        if moved:
            groups[at] = {"n": sum(moved.values()), "miss": 0, "first": None, "seen": at, "closed": None, "reason": None, "asked": False}
    else:
        for g in open_now:
            if not g["miss"]:
                g["seen"] = at
        missing = [g for g in open_now if g["miss"]]
    fresh = sum(g["n"] for g in missing if not g["miss"])
    result |= {"missing": sum(g["n"] for g in missing), "newly": fresh}
    if result["open"] >= HOLD_LEAST and fresh > HOLD_SHARE * result["open"]:
        state["held"] += 1
        state["held_since"] = at if state["held_since"] is None else state["held_since"]
        result["held"] = True
        if state["held"] >= HOLD_READINGS and at - state["held_since"] >= HOLD_SPAN:
            result["held"] = False
            for g in missing:
                close(g, "mass_close")
            state["held"], state["held_since"] = 0, None
        return result
    state["held"], state["held_since"] = 0, None
    for g in missing:
        g["miss"] += 1
        g["first"] = at if g["first"] is None else g["first"]
        if g["miss"] >= 2 and (at - g["first"] >= CONFIRM_GAP or at - g["seen"] >= GRACE):
            close(g, "missing")
    return result


def _group_row(at: float, s: float, g: dict) -> dict:
    return {"at": at, "what": "group", "listed_at": s, "n": g["n"], "miss_count": g["miss"], "last_seen": g["seen"], "closed_at": g["closed"], "closed_reason": g["reason"]}


_COLUMNS = [c.split()[0] for c in TOLD.split(", ")]


def _told(ats: str, board: str, rows: list[dict]) -> pd.DataFrame:
    """Rows of the fold, as told; seconds become microseconds."""
    out = {c: [r.get(c) for r in rows] for c in _COLUMNS}
    for c in TIMES:
        out[c] = [None if x is None else round(x * 1e6) for x in out[c]]
    kinds = {"what": "string", "closed_reason": "string", "held": "boolean"}
    frame = pd.DataFrame({c: pd.array(v, dtype=kinds.get(c, "Int64")) for c, v in out.items() if c not in ("ats", "board")})
    return frame.assign(ats=ats, board=board)[_COLUMNS]


def _read(pdf: pd.DataFrame) -> Iterator[tuple[float, str, dict]]:
    """Readings of one board in order: time, kind, moves."""
    for at, rows in pdf.groupby("at", sort=True):
        kinds = [k for k in rows["kind"] if isinstance(k, str)]
        sizes: dict[float | None, int] = {}
        for before, n in zip(rows["before"], rows["n"], strict=True):
            if not pd.isna(n):
                key = None if pd.isna(before) else int(before) / 1e6
                sizes[key] = sizes.get(key, 0) + int(n)
        yield int(at) / 1e6, kinds[0] if kinds else "listing", sizes


def _timed(rows: DataFrame) -> DataFrame:
    return rows.withColumns({c: F.timestamp_micros(c) for c in TIMES})


# ---- batch


def distinct_readings(readings: DataFrame) -> DataFrame:
    """``(ats, board, reading_ts, kind)``, one row a board and time."""
    says = F.coalesce(F.array_position(F.array(*[F.lit(k) for k in SAYS]), F.col("kind")), F.lit(0))
    return readings.groupBy("ats", "board", "reading_ts").agg(F.max_by("kind", says).alias("kind"))


def listings(readings: DataFrame) -> DataFrame:
    """``(ats, board, reading_ts, posting)`` once each."""
    return readings.where("kind = 'listing'").select("ats", "board", "reading_ts", F.explode("listed").alias("posting")).distinct()


def moves(listed: DataFrame) -> DataFrame:
    """``(ats, board, reading_ts, before, n)``: how many postings a reading lists, by the reading that listed them before."""
    own = Window.partitionBy("ats", "board", "posting").orderBy("reading_ts")
    return listed.withColumn("before", F.lag("reading_ts").over(own)).groupBy("ats", "board", "reading_ts", "before").agg(F.count("*").alias("n"))


def told(readings: DataFrame) -> DataFrame:
    """The fold of every board over its readings and moves: final states of groups, results, confirmations."""

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        state, rows = new_board(), []
        for at, kind, moved in _read(pdf):
            rows += confirmations(state, at - 1e-6)
            result = apply_reading(state, at, kind, moved)
            rows += [result] if result else []
        rows += confirmations(state, float("inf"))
        rows += [_group_row(state["at"], s, g) for s, g in sorted(state["groups"].items())]
        return _told(*key, rows)

    kinds, sizes = distinct_readings(readings), moves(listings(readings))
    both = kinds.join(sizes, ["ats", "board", "reading_ts"], "left")
    both = both.select("ats", "board", "kind", F.unix_micros("reading_ts").alias("at"), F.unix_micros("before").alias("before"), "n")
    return _timed(both.groupBy("ats", "board").applyInPandas(run, TOLD))


def postings_of(listed: DataFrame, states: DataFrame) -> DataFrame:
    """The state of every posting: that of the group of its last listing."""
    last = listed.groupBy("ats", "board", "posting").agg(F.max("reading_ts").alias("listed_at"))
    group = states.where("what = 'group'").groupBy("ats", "board", "listed_at").agg(F.max_by(F.struct("miss_count", "last_seen", "closed_at", "closed_reason"), "at").alias("g"))
    return last.join(group, ["ats", "board", "listed_at"]).select("ats", "board", "posting", "g.miss_count", "g.last_seen", "g.closed_at", "g.closed_reason")


def settle(readings: DataFrame) -> DataFrame:
    """Final posting states of a finished log of readings."""
    return postings_of(listings(readings), told(readings))


# ---- stream

MOVED = "ats string, board string, reading_ts timestamp, kind string, at long, before long, n long"


class Moves(StatefulProcessor):
    """Part of a board's postings: waits for a reading's time to pass, then tells which readings listed its postings before."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "at long", "kind string, postings array<string>")
        self.listed = handle.getMapState("listed", "posting string", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new: dict[int, tuple[list, list]] = {}
        for pdf in rows:
            for at, kind, posting in zip(pdf["at"], pdf["kind"], pdf["posting"], strict=True):
                kinds, postings = new.setdefault(int(at), ([], []))
                if isinstance(posting, str):
                    postings.append(posting)
                if isinstance(kind, str):
                    kinds.append(kind)
        for at, (kinds, postings) in new.items():
            old = self.waiting.getValue((at,)) if self.waiting.containsKey((at,)) else (None, [])
            kind = max([k for k in [*kinds, old[0]] if k], key=SAYS.index, default=None)
            self.waiting.updateValue((at,), (kind, [*old[1], *postings]))
            self.handle.registerTimer(-(-at // 1000))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        upto = expiredTimerInfo.getExpiryTimeInMs() * 1000
        ats, board = key[0], key[1]
        out = []
        for at in sorted(k[0] for k in self.waiting.keys()):
            if at > upto:
                break
            kind, postings = self.waiting.getValue((at,))
            sizes: dict[int | None, int] = {}
            for p in dict.fromkeys(postings):
                before = self.listed.getValue((p,))[0] if self.listed.containsKey((p,)) else None
                sizes[before] = sizes.get(before, 0) + 1
                self.listed.updateValue((p,), (at,))
            ts = pd.Timestamp(at, unit="us", tz="UTC")
            if kind:
                out.append((ats, board, ts, kind, at, None, None))
            out += [(ats, board, ts, None, at, b, n) for b, n in sizes.items()]
            self.waiting.removeKey((at,))
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in MOVED.split(", ")]).astype({"kind": "string", "before": "Int64", "n": "Int64"})

    def close(self) -> None:
        pass


class Boards(StatefulProcessor):
    """A board: its groups and guard, over readings that arrive in order."""

    FIELDS = ("n", "miss", "first", "seen", "closed", "reason", "asked")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.board = handle.getValueState("board", "at double, held int, held_since double, empty int, yielded double")
        self.groups = handle.getMapState("groups", "listed_at double", "n long, miss int, first double, seen double, closed double, reason string, asked boolean")

    def _load(self) -> dict:
        state = new_board()
        if self.board.exists():
            state |= dict(zip(("at", "held", "held_since", "empty", "yielded"), self.board.get(), strict=True))
        state["groups"] = {k[0]: dict(zip(self.FIELDS, v, strict=True)) for k, v in self.groups.iterator()}
        return state

    def _save(self, state: dict, before: dict) -> list[float]:
        """Write what changed; the groups that did."""
        self.board.update(tuple(state[c] for c in ("at", "held", "held_since", "empty", "yielded")))
        changed = [s for s, g in state["groups"].items() if before.get(s) != g]
        for s in changed:
            self.groups.updateValue((s,), tuple(state["groups"][s][c] for c in self.FIELDS))
        for s in before.keys() - state["groups"].keys():
            self.groups.removeKey((s,))
        return sorted(changed)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state, out = self._load(), []
        before = {s: dict(g) for s, g in state["groups"].items()}
        for at, kind, moved in _read(pd.concat(list(rows))):
            out += confirmations(state, at - 1e-6)
            result = apply_reading(state, at, kind, moved)
            if result:
                out.append(result)
                if result["newly"] and not result["held"]:
                    self.handle.registerTimer(int((at + CONFIRM_GAP) * 1000) + 1)
                if result["closed"]:
                    self.handle.registerTimer(int((at + EXPIRY) * 1000) + 1)
        out += [_group_row(state["at"], s, state["groups"][s]) for s in self._save(state, before)]
        if out:
            yield _told(key[0], key[1], out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, state = expiredTimerInfo.getExpiryTimeInMs() / 1000, self._load()
        before = {s: dict(g) for s, g in state["groups"].items()}
        out = confirmations(state, now)
        for s in [s for s, g in state["groups"].items() if g["closed"] is not None and g["closed"] + EXPIRY <= now]:
            del state["groups"][s]
        self._save(state, before)
        if out:
            yield _told(key[0], key[1], out)

    def close(self) -> None:
        pass


def told_stream(readings: DataFrame, late: str = "2 days", shards: int = 64) -> DataFrame:
    """What ``told`` tells, as the watermark passes it: readings may be ``late``, in any order; groups are told whenever they change.

    Append mode; the session needs the RocksDB state store.  ``postings_of`` turns it into posting states.
    """
    parts = F.concat(
        F.array(F.struct(F.lit(0).alias("shard"), F.col("kind"), F.lit(None).cast("string").alias("posting"))),
        F.transform(
            F.when((F.col("kind") == "listing") & F.col("listed").isNotNull(), F.col("listed")).otherwise(F.array().cast("array<string>")),
            lambda p: F.struct(F.pmod(F.xxhash64(p), F.lit(shards)).cast("int").alias("shard"), F.lit(None).cast("string").alias("kind"), p.alias("posting")),
        ),
    )
    rows = readings.withWatermark("reading_ts", late).select("ats", "board", "reading_ts", F.explode(parts).alias("p")).select("ats", "board", "reading_ts", F.unix_micros("reading_ts").alias("at"), "p.*")
    moved = rows.groupBy("ats", "board", "shard").transformWithStateInPandas(Moves(), MOVED, "Append", "EventTime", eventTimeColumnName="reading_ts")
    return _timed(moved.groupBy("ats", "board").transformWithStateInPandas(Boards(), TOLD, "Append", "EventTime"))


def sliding_quota(runs: DataFrame, key: str, ts: str, allowed: int) -> DataFrame:
    """Runs in the 24 hours up to each one, and when the next is allowed."""
    day = Window.partitionBy(key).orderBy(F.col(ts).cast("timestamp").cast("long")).rangeBetween(-86400, 0)
    nth = Window.partitionBy(key).orderBy(F.col(ts).desc(), F.col("event_id").desc())
    wait = F.lead(ts, allowed - 1).over(nth) + F.expr("INTERVAL 24 HOURS")
    return runs.withColumns({"in_day": F.count("*").over(day), "next_allowed": wait})
