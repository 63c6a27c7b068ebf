"""Streaming and state operators in their batch form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fernloom.registry import Tables, query
from fernloom.streaming import lifecycle as lc


#: Kinds of readings by board and day, for Spark and for the oracle: most are listings, one board falls empty for good.
_KIND = "CASE WHEN (b * 3 + d) % 13 = 0 THEN 'failed' WHEN (b * 3 + d) % 13 = 5 THEN 'not_modified' WHEN b = 7 AND d >= 12 OR (b + d) % 9 = 4 THEN 'empty' ELSE 'listing' END"


def readings(t: Tables) -> DataFrame:
    """Events as daily complete readings of twenty boards."""
    day = F.date_trunc("day", F.col("ts").cast("timestamp"))
    named = t.events.select((F.col("user_id") % 20).alias("b"), day.alias("reading_ts"), F.concat_ws("-", "event_type", F.col("user_id") % 7).alias("posting"))
    daily = named.groupBy("b", "reading_ts").agg(F.collect_set("posting").alias("listed")).withColumn("d", F.date_diff(F.to_date("reading_ts"), F.expr("DATE '2024-01-01'")))
    return daily.select(F.lit("ats").alias("ats"), F.col("b").cast("string").alias("board"), "reading_ts", F.expr(_KIND).alias("kind"), "listed")


#: The same rules on every posting by itself, a reading a step.
_LIFE = f"""WITH RECURSIVE e AS (SELECT user_id % 20 AS b, date_trunc('day', ts) AS tm, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS d, event_type || '-' || CAST(user_id % 7 AS VARCHAR) AS posting FROM events),
  r AS (SELECT *, row_number() OVER (PARTITION BY b ORDER BY tm) AS k FROM (SELECT DISTINCT b, CAST(epoch(tm) AS BIGINT) AS tm, {_KIND} AS kind FROM e)),
  l AS (SELECT DISTINCT e.b, k, posting FROM e JOIN r ON r.b = e.b AND r.tm = CAST(epoch(e.tm) AS BIGINT) WHERE kind = 'listing'),
  s AS (SELECT b, posting, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS tm, 0 AS held, CAST(NULL AS BIGINT) AS since, 0 AS empty, CAST(NULL AS BIGINT) AS yielded, FALSE AS known, 0 AS miss, CAST(NULL AS BIGINT) AS first,
      CAST(NULL AS BIGINT) AS seen, CAST(NULL AS BIGINT) AS closed, CAST(NULL AS VARCHAR) AS reason, FALSE AS was_open, FALSE AS lost, FALSE AS fresh, FALSE AS hold FROM (SELECT DISTINCT b, posting FROM l)
    UNION ALL
    SELECT b, posting, k, tm, CASE WHEN quiet THEN held WHEN guard AND NOT release THEN held + 1 ELSE 0 END, CASE WHEN quiet THEN since WHEN guard AND NOT release THEN coalesce(since, tm) END,
      CASE kind WHEN 'empty' THEN empty + 1 WHEN 'failed' THEN empty ELSE 0 END, CASE WHEN quiet THEN yielded ELSE tm END, known OR here, CASE WHEN here THEN 0 WHEN lost AND NOT guard THEN miss + 1 ELSE miss END,
      CASE WHEN here THEN NULL WHEN lost AND NOT guard THEN coalesce(first, tm) ELSE first END, CASE WHEN here THEN tm ELSE seen END,
      CASE WHEN here THEN NULL WHEN drop_all OR lost AND (release OR NOT guard AND gone) THEN tm ELSE closed END,
      CASE WHEN here THEN NULL WHEN drop_all THEN 'board_empty' WHEN lost AND release THEN 'mass_close' WHEN lost AND NOT guard AND gone THEN 'missing' ELSE reason END, was_open, lost, lost AND miss = 0, guard AND NOT release
    FROM (SELECT *, guard AND held + 1 >= 3 AND tm - coalesce(since, tm) >= 86400 AS release, miss + 1 >= 2 AND (tm - coalesce(first, tm) >= 7200 OR tm - seen >= 172800) AS gone,
        was_open AND kind = 'empty' AND empty + 1 >= 3 AND yielded IS NOT NULL AND tm - yielded >= 604800 AS drop_all
      FROM (SELECT *, NOT quiet AND count(*) FILTER (was_open) OVER w >= 10 AND count(*) FILTER (lost AND miss = 0) OVER w > 0.5 * count(*) FILTER (was_open) OVER w AS guard
        FROM (SELECT *, was_open AND NOT here AND NOT quiet AS lost
          FROM (SELECT s.b, s.posting, r.k, r.tm, r.kind, s.held, s.since, s.empty, s.yielded, s.known, s.miss, s.first, s.seen, s.closed, s.reason, s.known AND s.closed IS NULL AS was_open, r.kind IN ('empty', 'failed') AS quiet,
              CASE r.kind WHEN 'listing' THEN l.posting IS NOT NULL WHEN 'not_modified' THEN s.known AND s.closed IS NULL AND s.miss = 0 ELSE FALSE END AS here
            FROM s JOIN r ON r.b = s.b AND r.k = s.k + 1 LEFT JOIN l ON l.b = s.b AND l.k = r.k AND l.posting = s.posting)) WINDOW w AS (PARTITION BY b))))"""


def _plain_times(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})


@query("st_reading", f"{_LIFE} SELECT 'ats' AS ats, CAST(b AS VARCHAR) AS board, posting, CAST(miss AS INTEGER) AS miss_count, CAST(make_timestamp(seen * 1000000) AS TIMESTAMP) AS last_seen, CAST(make_timestamp(closed * 1000000) AS TIMESTAMP) AS closed_at, reason AS closed_reason FROM s WHERE known AND k = (SELECT max(k) FROM r WHERE r.b = s.b)")
def st_reading(t: Tables) -> DataFrame:
    return _plain_times(lc.settle(readings(t)), "last_seen", "closed_at")


@query("st_reading_log", f"{_LIFE} SELECT CAST(b AS VARCHAR) AS board, make_timestamp(tm * 1000000) AS \"at\", count(*) FILTER (was_open) AS open, count(*) FILTER (lost) AS missing, count(*) FILTER (fresh) AS newly, count(*) FILTER (was_open AND closed = tm) AS closed, bool_or(hold) AS held FROM s WHERE k > 0 GROUP BY b, k, tm")
def st_reading_log(t: Tables) -> DataFrame:
    """What each reading found and did: open, missing and newly missing postings, closed ones, and whether the guard held it."""
    told = lc.told(readings(t)).where("what = 'reading'")
    listed_ever = lc.listings(readings(t)).select("board").distinct()  # boards that never list have no postings to tell of
    return _plain_times(told.join(listed_ever, "board", "left_semi").select("board", "at", "open", "missing", "newly", "closed", "held"), "at")


@query("st_confirm_task", f"{_LIFE} SELECT CAST(b AS VARCHAR) AS board, make_timestamp((tm + 7200) * 1000000) AS confirm_at, count(*) AS postings FROM s WHERE fresh AND NOT hold AND closed IS NULL GROUP BY b, tm")
def st_confirm_task(t: Tables) -> DataFrame:
    """Confirming readings asked for two hours after a first miss (readings here are a day apart, so nothing comes between)."""
    told = lc.told(readings(t)).where("what = 'confirm'")
    return _plain_times(told.select("board", F.col("at").alias("confirm_at"), F.col("n").alias("postings")), "confirm_at")


@query("st_not_modified", "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 1 ELSE 0 END + CASE WHEN o_orderkey % 4 = 0 THEN 1 ELSE 0 END AS misses FROM orders WHERE o_orderstatus = 'O'")
def st_not_modified(t: Tables) -> DataFrame:
    """An unchanged answer: rows without a miss are seen again, missing ones miss once more."""
    missed = F.when(F.col("o_orderkey") % 4 == 0, 1).otherwise(0)
    return t.orders.where("o_orderstatus = 'O'").select("o_orderkey", F.when(missed > 0, missed + 1).otherwise(0).alias("misses"))


@query("st_board_qualifies", "SELECT l_suppkey, count(*) FILTER (l_returnflag = 'A') = 0 OR (count(*) > 0 AND count(*) FILTER (l_quantity > 49) * 20 <= count(*)) AS qualifies FROM lineitem GROUP BY 1")
def st_board_qualifies(t: Tables) -> DataFrame:
    clean, few = F.count_if(F.col("l_returnflag") == "A") == 0, F.count_if(F.col("l_quantity") > 49) * 20 <= F.count("*")
    return t.lineitem.groupBy("l_suppkey").agg((clean | few).alias("qualifies"))


def streaks(rows: DataFrame, by: str, order: str, flag: str) -> DataFrame:
    """Length of the run of true flags up to each row."""
    w = Window.partitionBy(by).orderBy(order, "event_id")
    broken = F.sum((~F.col(flag)).cast("int")).over(w)
    grouped = rows.withColumn("__g", broken)
    return grouped.withColumn("streak", F.sum(F.col(flag).cast("int")).over(Window.partitionBy(by, "__g").orderBy(order, "event_id")).cast("long")).drop("__g")


_STREAK = "SELECT *, CAST(sum(CAST(f AS INT)) OVER (PARTITION BY user_id, g ORDER BY ts, event_id) AS BIGINT) AS streak FROM (SELECT *, sum(CAST(NOT f AS INT)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM (SELECT *, {} AS f FROM events))"


@query("st_empty_feed", f"SELECT event_id FROM ({_STREAK.format('value < 40')}) WHERE streak >= 3")
def st_empty_feed(t: Tables) -> DataFrame:
    return streaks(t.events.withColumn("f", F.col("value") < 40), "user_id", "ts", "f").where("streak >= 3").select("event_id")


@query("st_too_broad", "SELECT o_custkey, count(*) >= 10 AND count(*) FILTER (o_orderstatus = 'F') * 2 > count(*) AS held FROM orders GROUP BY 1")
def st_too_broad(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_custkey").agg(((F.count("*") >= 10) & (F.count_if(F.col("o_orderstatus") == "F") * 2 > F.count("*"))).alias("held"))


@query("st_board_success", "SELECT user_id, max(ts) AS last_yield, count(*) AS ok FROM events WHERE value >= 40 GROUP BY 1")
def st_board_success(t: Tables) -> DataFrame:
    return t.events.where("value >= 40").groupBy("user_id").agg(F.max("ts").alias("last_yield"), F.count("*").alias("ok"))


@query("st_board_failure", f"SELECT event_id, streak, CASE WHEN streak >= 3 THEN least(6 * pow(2, streak - 3), 24.0::DOUBLE) END AS cooldown_h FROM ({_STREAK.format('value < 40')}) WHERE f")
def st_board_failure(t: Tables) -> DataFrame:
    from fernloom.functions.facts import cooldown_hours

    out = streaks(t.events.withColumn("f", F.col("value") < 40), "user_id", "ts", "f").where("f")
    return out.select("event_id", "streak", cooldown_hours(F.col("streak")).alias("cooldown_h"))


@query("st_refresh_scope", "WITH s AS (SELECT o_custkey, o_orderkey, o_orderkey % 3 <> 0 AS listed FROM orders WHERE o_orderstatus = 'O'), g AS (SELECT o_custkey, count(*) >= 10 AND count(*) FILTER (NOT listed) * 2 > count(*) AS held FROM s GROUP BY 1) SELECT o_orderkey, NOT listed AND NOT held AS close FROM s JOIN g USING (o_custkey)")
def st_refresh_scope(t: Tables) -> DataFrame:
    """Unlisted rows close unless too many would."""
    s = t.orders.where("o_orderstatus = 'O'").select("o_custkey", "o_orderkey", (F.col("o_orderkey") % 3 != 0).alias("listed"))
    g = s.groupBy("o_custkey").agg(((F.count("*") >= 10) & (F.count_if(~F.col("listed")) * 2 > F.count("*"))).alias("held"))
    return s.join(g, "o_custkey").select("o_orderkey", (~F.col("listed") & ~F.col("held")).alias("close"))


@query("st_settle_board", "SELECT o_orderkey, EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linestatus = 'O') AS open FROM orders")
def st_settle_board(t: Tables) -> DataFrame:
    """Open while any source lists it."""
    listed = t.lineitem.where("l_linestatus = 'O'").select(F.col("l_orderkey").alias("o_orderkey")).distinct().withColumn("open", F.lit(True))
    return t.orders.select("o_orderkey").join(listed, "o_orderkey", "left").withColumn("open", F.coalesce("open", F.lit(False)))


@query("st_rate_window", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW) AS in_day, lead(ts, 2) OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) + INTERVAL 24 HOUR AS next_allowed FROM (SELECT *, CAST(floor(epoch(ts)) AS BIGINT) AS epoch FROM events)")
def st_rate_window(t: Tables) -> DataFrame:
    return lc.sliding_quota(t.events, "user_id", "ts", 3).select("event_id", "in_day", "next_allowed")


@query("st_reserve_lease", "SELECT user_id, min(event_id) AS holder FROM events WHERE event_type = 'login' OR event_type = (SELECT min(event_type) FROM events) GROUP BY user_id")
def st_reserve_lease(t: Tables) -> DataFrame:
    """One holder per key: the first asker."""
    kind = t.events.agg(F.min("event_type").alias("k"))
    asked = t.events.crossJoin(kind).where((F.col("event_type") == "login") | (F.col("event_type") == F.col("k")))  # one row
    return asked.groupBy("user_id").agg(F.min("event_id").alias("holder"))


@query("st_vec_incremental", "SELECT CAST(i - 1 AS INT) AS dim, round(avg(CAST(x AS DOUBLE)), 9) AS mean FROM (SELECT unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY i")
def st_vec_incremental(t: Tables) -> DataFrame:
    """Sums and counts of two parts add up to the mean of the whole."""
    part = lambda c: t.embeddings.where(c).select(F.posexplode("embedding").alias("dim", "x")).groupBy("dim").agg(F.sum(F.col("x").cast("double")).alias("s"), F.count("*").alias("n"))
    both = part("vec_id % 2 = 0").unionAll(part("vec_id % 2 = 1"))
    return both.groupBy("dim").agg(F.round(F.sum("s") / F.sum("n"), 9).alias("mean"))


@query("st_fit_queue", "SELECT doc_id FROM documents WHERE (doc_id, n_chars % 3) NOT IN (SELECT vec_id, CAST(label % 3 AS BIGINT) FROM embeddings)")
def st_fit_queue(t: Tables) -> DataFrame:
    """Rows whose embedding is missing or stale."""
    have = t.embeddings.select(F.col("vec_id").alias("doc_id"), (F.col("label") % 3).cast("long").alias("hash"))
    return t.documents.select("doc_id", (F.col("n_chars") % 3).alias("hash")).join(have, ["doc_id", "hash"], "left_anti").select("doc_id")


@query("st_notify_dedupe", "SELECT user_id, event_type FROM events GROUP BY 1, 2")
def st_notify_dedupe(t: Tables) -> DataFrame:
    return t.events.select("user_id", "event_type").dropDuplicates()


@query("st_reminder_tick", "SELECT event_id FROM events WHERE ts <= TIMESTAMP '2024-01-02' AND value > 90")
def st_reminder_tick(t: Tables) -> DataFrame:
    return t.events.where("ts <= TIMESTAMP_NTZ '2024-01-02 00:00:00' AND value > 90").select("event_id")


@query("st_activity_timer", "SELECT event_id, least(date_diff('second', ts, nxt), 28800) AS seconds FROM (SELECT event_id, date_trunc('second', ts) AS ts, date_trunc('second', lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS nxt FROM events) WHERE date_diff('second', ts, nxt) >= 60")
def st_activity_timer(t: Tables) -> DataFrame:
    """From one event of a user to the next, eight hours at most, under a minute not at all."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    second = lambda c: F.date_trunc("second", c.cast("timestamp"))
    seconds = F.unix_seconds(second(F.lead("ts").over(w))) - F.unix_seconds(second(F.col("ts")))
    return t.events.select("event_id", seconds.alias("s")).where("s >= 60").select("event_id", F.least("s", F.lit(28800)).alias("seconds"))


@query("st_run_resume", "SELECT user_id FROM events GROUP BY user_id HAVING arg_max(event_type, (ts, event_id)) <> (SELECT max(event_type) FROM events)")
def st_run_resume(t: Tables) -> DataFrame:
    """Keys whose last step is not the closing one."""
    last = t.events.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("last"))
    return last.crossJoin(t.events.agg(F.max("event_type").alias("k"))).where("last <> k").select("user_id")  # one row
