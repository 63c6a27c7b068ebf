r"""Chat formatting by quotation linking, with native functions only.

A line's quote level is the number of ``>`` in its leading run of markers.  Consecutive
lines of one level make a quoted passage.  Passages are normalised (markers off, lower
case, white space collapsed) and hashed; the same is done to every message's own text,
as a whole, by paragraph and by line.  A passage is linked to the latest earlier message
of its conversation with that hash.  Where there is none, as for one of several paragraphs or
lines, it is split into its paragraphs and lines: each votes for the latest earlier message of
the conversation that holds it, and the message with most votes is taken, the latest on ties.
A passage that nothing of its own conversation matches is linked to the first message of any.

A message replies to the latest message its level-1 passages are linked to within the
conversation, else to the one before it.  Reply order is the preorder of that tree:
a chain of messages without jumps is a branch; branches hang on the message quoted,
later attachments first, so each reply follows what it answers.

No step gathers a conversation: running values and numbers are computed in ranges of
``SPAN`` turns and joined by the ranges' totals.

Defined cases: a null text is empty; a message whose conv_id or turn is null stays, is
linked to nothing and gets no position; several messages of one turn are ordered by
role, then text; an empty passage is linked to nothing; attribution lines ("On ...
wrote:") directly before a quote belong to the quote; extra columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fernloom.scratch import materialize

SPAN = 1024
MARKERS = r"^[ \t]*((?:>[ \t]?)+)"
ATTRIBUTION = r"(?i)^(?:on|le|am|el)\b.*(?:wrote|écrit|schrieb|escribió) ?:[ \t]*$"
PASSAGE = "struct<level:int,text:string>"
KEY = ["conv_id", "turn", "ord"]


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[\s>]+", " "))


def _lines(text: Column) -> Column:
    """array<struct<level,body>> of a message's lines."""
    return F.transform(
        F.split(text, "\n", -1),
        lambda x: F.struct(F.length(F.regexp_replace(F.regexp_extract(x, MARKERS, 1), "[^>]", "")).alias("level"), F.regexp_replace(x, MARKERS, "").alias("body")),
    )


def _passages(lines: Column) -> Column:
    """Quoted passages: runs of lines of one level."""
    nothing = F.array().cast(f"array<{PASSAGE}>")
    start = F.struct(nothing.alias("out"), F.lit(0).alias("level"), F.lit("").alias("text"))

    def closed(a: Column) -> Column:
        return F.when(a["level"] > 0, F.concat(a["out"], F.array(F.struct(a["level"].alias("level"), a["text"].alias("text"))))).otherwise(a["out"])

    def step(a: Column, x: Column) -> Column:
        same = F.struct(a["out"].alias("out"), a["level"].alias("level"), F.concat(a["text"], F.lit("\n"), x["body"]).alias("text"))
        other = F.struct(closed(a).alias("out"), x["level"].alias("level"), x["body"].alias("text"))
        return F.when(a["level"] == x["level"], same).otherwise(other)

    return F.aggregate(lines, start, step, closed)


def parse(messages: DataFrame) -> DataFrame:
    """``(conv_id, turn, ord, role, own, passages)``: text without quotes, and the quotes."""
    same = Window.partitionBy("conv_id", "turn").orderBy("role", "text")
    out = messages.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    placed = F.col("conv_id").isNotNull() & F.col("turn").isNotNull()
    # rows without a place are only told apart; they never meet in one window
    loose = out.where(~placed).withColumn("ord", F.monotonically_increasing_id())
    out = out.where(placed).withColumn("ord", F.row_number().over(same).cast("long")).unionByName(loose)
    out = out.withColumn("quoting", F.col("text").rlike(r"(?m)" + MARKERS))
    out = out.withColumn("lines", F.when(F.col("quoting"), _lines(F.col("text"))))
    quoted_next = F.transform("lines", lambda x, i: F.coalesce(F.get(F.col("lines"), i + 1)["level"], F.lit(0)) > 0)
    own = F.filter(F.zip_with("lines", quoted_next, lambda x, q: F.struct(x.alias("x"), q.alias("q"))), lambda z: (z["x"]["level"] == 0) & ~(z["q"] & z["x"]["body"].rlike(ATTRIBUTION)))
    own = F.regexp_replace(F.array_join(F.transform(own, lambda z: z["x"]["body"]), "\n"), r"^\s+|\s+$", "")
    return out.select(
        *KEY,
        "role",
        F.when(F.col("quoting"), own).otherwise(F.col("text")).alias("own"),
        F.when(F.col("quoting"), _passages(F.col("lines"))).otherwise(F.array().cast(f"array<{PASSAGE}>")).alias("passages"),
    )


def _originals(parsed: DataFrame) -> DataFrame:
    """Hashes under which a message can be quoted: its own text, its paragraphs, its lines."""
    parts = F.concat(F.array("own"), F.split("own", r"\n[ \t]*\n"), F.split("own", "\n"))
    hashes = F.array_distinct(F.transform(F.filter(F.transform(parts, normalised), lambda x: x != ""), lambda x: F.md5(x)))
    return parsed.where("conv_id IS NOT NULL AND turn IS NOT NULL").select("conv_id", "turn", F.explode(hashes).alias("hash"))


def _latest_earlier(asked: DataFrame, said: DataFrame) -> DataFrame:
    """``asked (conv_id, hash, turn)`` plus ``found``: the latest earlier turn of ``said``, by ranges of turns.

    Both sides are merged and a running maximum goes over them, so a line that is said and quoted any number
    of times makes no pairs; within a hash a range of ``SPAN`` turns and the ranges' maxima are ordered apart.
    """
    asked, key = asked.dropna().distinct(), ["conv_id", "hash"]
    said = said.select(*key, "turn").join(asked.select(*key).distinct(), key, "left_semi")
    span = F.floor(F.col("turn") / SPAN).alias("span")
    spans = said.groupBy(*key, span).agg(F.max("turn").alias("latest")).unionByName(asked.select(*key, span).distinct(), allowMissingColumns=True)
    spans = spans.groupBy(*key, "span").agg(F.max("latest").alias("latest"))
    before = Window.partitionBy(*key).orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select(*key, "span", F.max("latest").over(before).alias("carried"))
    both = said.select(*key, "turn", F.col("turn").alias("at")).unionByName(asked.select(*key, "turn"), allowMissingColumns=True).select("*", span)
    inside = Window.partitionBy(*key, "span").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    own = both.withColumn("inside", F.max("at").over(inside)).where("at IS NULL").join(spans, [*key, "span"])
    return own.select(*key, "turn", F.coalesce("inside", "carried").alias("found"))


def _voted(passages: DataFrame, originals: DataFrame) -> DataFrame:
    """``(KEY, at, voted)`` of passages ``(KEY, at, text)``: the earlier turn that most paragraphs and lines were last seen in."""
    parts = F.concat(F.split("text", r"\n[ \t]*\n"), F.split("text", "\n"))
    hashes = F.array_distinct(F.transform(F.filter(F.transform(parts, normalised), lambda x: x != ""), lambda x: F.md5(x)))
    units = materialize(passages.select(*KEY, "at", F.explode(hashes).alias("hash")), "units")  # read several times below
    found = _latest_earlier(units.select("conv_id", "hash", "turn"), originals).where("found IS NOT NULL")
    votes = units.join(found, ["conv_id", "hash", "turn"]).groupBy(*KEY, "at", "found").agg(F.count("*").alias("n"))
    return votes.groupBy(*KEY, "at").agg(F.max(F.struct("n", "found")).alias("v")).select(*KEY, "at", F.col("v.found").alias("voted"))


def links(parsed: DataFrame) -> DataFrame:
    """One row per quoted passage: ``(conv_id, turn, ord, at, level, from_conv, from_turn)``."""
    quoted = parsed.where("size(passages) > 0").select(*KEY, F.posexplode("passages").alias("at", "p"))
    quoted = quoted.select(*KEY, "at", "p.level", "p.text", normalised(F.col("p.text")).alias("t")).select(*KEY, "at", "level", "text", F.when(F.col("t") != "", F.md5("t")).alias("hash"))
    originals = _originals(parsed)
    found = _latest_earlier(quoted.select("conv_id", "hash", "turn"), originals).withColumnRenamed("found", "own_turn")
    own = materialize(quoted.join(found, ["conv_id", "hash", "turn"], "left").select(*KEY, "at", "level", "text", "hash", "own_turn"), "own-links")
    voted = _voted(own.where("own_turn IS NULL AND hash IS NOT NULL"), originals)
    both = own.join(voted, [*KEY, "at"], "left").withColumn("own_turn", F.coalesce("own_turn", "voted"))
    both = materialize(both, "thread-links")
    wanted = both.where("own_turn IS NULL AND hash IS NOT NULL").select("hash").distinct()
    first = originals.join(wanted, "hash", "left_semi").groupBy("hash").agg(F.min(F.struct("conv_id", "turn")).alias("first"))
    both = both.join(first, "hash", "left").withColumn("first", F.when(~((F.col("first.conv_id") == F.col("conv_id")) & (F.col("first.turn") >= F.col("turn"))), F.col("first")))
    return both.select(
        *KEY,
        "at",
        "level",
        F.when(F.col("own_turn").isNotNull(), F.col("conv_id")).otherwise(F.col("first.conv_id")).alias("from_conv"),
        F.coalesce("own_turn", "first.turn").alias("from_turn"),
    )


def _last_before(marked: DataFrame, value: str) -> DataFrame:
    """``marked`` plus ``head``, the latest non-null ``value`` of its conversation up to its turn, by ranges of turns."""
    ranged = marked.withColumn("span", F.floor(F.col("turn") / SPAN))
    spans = ranged.groupBy("conv_id", "span").agg(F.max(value).alias("latest"))
    before = Window.partitionBy("conv_id").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select("conv_id", "span", F.max("latest").over(before).alias("carried"))
    inside = Window.partitionBy("conv_id", "span").orderBy("turn").rangeBetween(Window.unboundedPreceding, 0)
    return ranged.withColumn("inside", F.max(value).over(inside)).join(spans, ["conv_id", "span"]).withColumn("head", F.coalesce("inside", "carried")).drop("inside", "carried")


def branch_paths(branches: DataFrame) -> DataFrame:
    """``(conv_id, head, path)`` of branches ``(conv_id, head, attach, up)`` by pointer doubling; depth d takes log d rounds."""
    step = F.array(F.struct((-F.col("attach")).alias("a"), F.col("head").alias("h")))
    now = materialize(branches.select("conv_id", "head", step.alias("path"), "up"), "branches")
    while not now.where("up IS NOT NULL").isEmpty():
        above = now.select("conv_id", F.col("head").alias("up"), F.col("path").alias("above"), F.col("up").alias("next"))
        now = materialize(
            now.join(above, ["conv_id", "up"], "left").select("conv_id", "head", F.when(F.col("up").isNull(), F.col("path")).otherwise(F.concat("above", "path")).alias("path"), F.col("next").alias("up")),
            "branches",
        )
    return now.drop("up")


def reply_order(messages: DataFrame) -> DataFrame:
    """One row per message: text without quotes, quote counts, what it replies to, its branch and position."""
    parsed = materialize(parse(messages), "parsed")
    linked = materialize(links(parsed), "links")
    parents = linked.groupBy(*KEY).agg(
        F.max(F.when((F.col("level") == 1) & (F.col("from_conv") == F.col("conv_id")), F.col("from_turn"))).alias("parent"),
        F.count("from_turn").alias("n_linked"),
    )
    known = parsed.where("conv_id IS NOT NULL AND turn IS NOT NULL").select(*KEY)
    jumps = parents.where("parent IS NOT NULL").groupBy("conv_id", "turn").agg(F.max("parent").alias("attach"))
    marked = known.join(jumps, ["conv_id", "turn"], "left")
    # a reply to the turn before it continues the branch
    placed = materialize(_last_before(marked.withColumn("start", F.when(F.col("attach") < F.col("turn") - 1, F.col("turn"))), "start"), "placed")
    heads = placed.where("start IS NOT NULL").select("conv_id", F.col("start").alias("head"), "attach").distinct()
    up = placed.groupBy("conv_id", F.col("turn").alias("attach")).agg(F.max("head").alias("up"))
    paths = branch_paths(heads.join(up, ["conv_id", "attach"], "left"))
    # position: messages of earlier branches, of earlier ranges of the branch, and earlier in the range
    root = F.coalesce("head", F.lit(-1))
    placed = placed.withColumn("branch", root.cast("long"))
    spans = placed.groupBy("conv_id", "branch", "span").agg(F.count("*").alias("n"))
    sizes = spans.groupBy("conv_id", "branch").agg(F.sum("n").alias("n")).join(paths.select("conv_id", F.col("head").cast("long").alias("branch"), "path"), ["conv_id", "branch"], "left")
    sizes = sizes.withColumn("path", F.coalesce("path", F.array().cast("array<struct<a:bigint,h:bigint>>")))
    rows = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    earlier = sizes.select("conv_id", "branch", F.coalesce(F.sum("n").over(rows(Window.partitionBy("conv_id").orderBy("path"))), F.lit(0)).alias("b0"))
    ranges = spans.select("conv_id", "branch", "span", F.coalesce(F.sum("n").over(rows(Window.partitionBy("conv_id", "branch").orderBy("span"))), F.lit(0)).alias("s0"))
    number = F.row_number().over(Window.partitionBy("conv_id", "branch", "span").orderBy("turn", "ord")) - 1
    placed = placed.withColumn("r", number).join(ranges, ["conv_id", "branch", "span"]).join(earlier, ["conv_id", "branch"])
    placed = placed.select(*KEY, "branch", (F.col("b0") + F.col("s0") + F.col("r")).cast("long").alias("position"))
    null_safe = lambda other: reduce(lambda a, b: a & b, [parsed[k].eqNullSafe(other[k]) for k in KEY])
    out = parsed.join(parents, null_safe(parents), "left").join(placed, null_safe(placed), "left")
    depth = F.coalesce(F.array_max(F.transform("passages", lambda p: p["level"])), F.lit(0))
    return out.select(
        parsed["conv_id"],
        parsed["turn"],
        parsed["role"],
        F.col("own").alias("text"),
        F.size("passages").cast("long").alias("n_quotes"),
        depth.cast("long").alias("depth"),
        F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
        F.col("parent").alias("quoted_turn"),
        "branch",
        "position",
    )


def chat(ordered: DataFrame, messages_per_row: int = 256) -> DataFrame:
    """Formatted conversations in reply order, cut into rows of a bounded number of messages."""
    line = F.concat(F.lit("<|"), F.coalesce("role", F.lit("")), F.lit("|>\n"), "text")
    rows = ordered.where("position IS NOT NULL").groupBy("conv_id", F.floor(F.col("position") / messages_per_row).alias("part"))
    parts = rows.agg(F.array_sort(F.collect_list(F.struct("position", line.alias("line")))).alias("m"))
    return parts.select("conv_id", "part", F.array_join(F.transform("m", lambda x: x["line"]), "\n").alias("chat"))


def quote_free_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations of ``conversations``, formatted without quotes and in reply order."""
    return chat(op1_quotation_linking(spark, sf_dir))


def op1_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message of ``conversations`` without its quotes, linked and in reply order."""
    return reply_order(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


OP1_SQL = r"""
WITH RECURSIVE msg AS (
  SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, turn ORDER BY role NULLS FIRST, coalesce(text, '')) AS ord, role, coalesce(text, '') AS text FROM conversations
), ln AS (
  SELECT conv_id, turn, ord, unnest(range(1, len(ls) + 1)) AS i, unnest(ls) AS line FROM (SELECT *, string_split(text, chr(10)) AS ls FROM msg)
), lv AS (
  SELECT *, length(regexp_replace(regexp_extract(line, '^[ \t]*((?:>[ \t]?)+)', 1), '[^>]', '', 'g')) AS level, regexp_replace(line, '^[ \t]*((?:>[ \t]?)+)', '') AS body FROM ln
), nx AS (
  SELECT *, coalesce(lead(level) OVER w, 0) AS next_level, coalesce(lag(level) OVER w, -1) AS prev_level FROM lv WINDOW w AS (PARTITION BY conv_id, turn, ord ORDER BY i)
), own AS (
  SELECT m.conv_id, m.turn, m.ord, m.role, CASE WHEN max(n.level) > 0 THEN
    regexp_replace(coalesce(string_agg(n.body, chr(10) ORDER BY n.i) FILTER (n.level = 0 AND NOT (n.next_level > 0 AND
      regexp_matches(n.body, '(?i)^(?:on|le|am|el)\b.*(?:wrote|écrit|schrieb|escribió) ?:[ \t]*$'))), ''), '^\s+|\s+$', '', 'g')
    ELSE any_value(m.text) END AS own
  FROM msg m JOIN nx n ON (m.conv_id, m.turn, m.ord) IS NOT DISTINCT FROM (n.conv_id, n.turn, n.ord) GROUP BY 1, 2, 3, 4
), runs AS (
  SELECT *, sum(CASE WHEN level <> prev_level THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id, turn, ord ORDER BY i) AS run FROM nx
), quoted AS (
  SELECT conv_id, turn, ord, run, level, string_agg(body, chr(10) ORDER BY i) AS raw, trim(regexp_replace(lower(string_agg(body, chr(10) ORDER BY i)), '[\s>]+', ' ', 'g')) AS t
  FROM runs WHERE level > 0 GROUP BY 1, 2, 3, 4, 5
), src AS (
  SELECT DISTINCT conv_id, turn, trim(regexp_replace(lower(p), '[\s>]+', ' ', 'g')) AS t FROM (
    SELECT conv_id, turn, own AS p FROM own UNION ALL SELECT conv_id, turn, unnest(regexp_split_to_array(own, '\n[ \t]*\n')) FROM own
    UNION ALL SELECT conv_id, turn, unnest(string_split(own, chr(10))) FROM own)
), here AS (
  SELECT q.conv_id, q.turn, q.ord, q.run, q.level, q.t, any_value(q.raw) AS raw, max(s.turn) AS own_turn
  FROM quoted q LEFT JOIN src s ON q.conv_id = s.conv_id AND q.t = s.t AND s.turn < q.turn AND q.t <> '' GROUP BY 1, 2, 3, 4, 5, 6
), firsts AS (
  SELECT t, min((conv_id, turn)) AS f FROM src WHERE t <> '' AND conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY t
), whole AS (
  SELECT h.*, f.f IS NOT NULL AND NOT (f.f[1] = h.conv_id AND f.f[2] >= h.turn) AS elsewhere FROM here h LEFT JOIN firsts f ON h.t = f.t AND h.own_turn IS NULL
), units AS (
  SELECT DISTINCT conv_id, turn, ord, run, trim(regexp_replace(lower(p), '[\s>]+', ' ', 'g')) AS u FROM (
    SELECT conv_id, turn, ord, run, unnest(regexp_split_to_array(raw, '\n[ \t]*\n')) AS p FROM whole WHERE own_turn IS NULL
    UNION ALL SELECT conv_id, turn, ord, run, unnest(string_split(raw, chr(10))) FROM whole WHERE own_turn IS NULL)
), votes AS (
  SELECT conv_id, turn, ord, run, found, count(*) AS n FROM (
    SELECT u.conv_id, u.turn, u.ord, u.run, u.u, max(s.turn) AS found FROM units u JOIN src s ON u.conv_id = s.conv_id AND u.u = s.t AND s.turn < u.turn AND u.u <> '' GROUP BY 1, 2, 3, 4, 5) GROUP BY 1, 2, 3, 4, 5
), pick AS (
  SELECT conv_id, turn, ord, run, arg_max(found, (n, found)) AS voted FROM votes GROUP BY 1, 2, 3, 4
), lk AS (
  SELECT w.conv_id, w.turn, w.ord, w.run, w.level, coalesce(w.own_turn, p.voted) AS own_turn, w.elsewhere FROM whole w LEFT JOIN pick p USING (conv_id, turn, ord, run)
), par AS (
  SELECT conv_id, turn, ord, max(own_turn) FILTER (level = 1) AS own_parent, count(*) FILTER (own_turn IS NOT NULL OR elsewhere) AS n_linked,
         count(*) AS n_quotes, max(level) AS depth FROM lk GROUP BY 1, 2, 3
), jump AS (
  SELECT conv_id, turn, max(own_parent) AS attach FROM par GROUP BY 1, 2
), placed AS (
  SELECT m.conv_id, m.turn, m.ord, max(CASE WHEN j.attach < m.turn - 1 THEN m.turn END) OVER (PARTITION BY m.conv_id ORDER BY m.turn) AS head,
         CASE WHEN j.attach < m.turn - 1 THEN j.attach END AS attach
  FROM msg m LEFT JOIN jump j ON m.conv_id = j.conv_id AND m.turn = j.turn WHERE m.conv_id IS NOT NULL AND m.turn IS NOT NULL
), br AS (
  SELECT DISTINCT p.conv_id, p.turn AS head, p.attach, u.head AS up FROM placed p
  LEFT JOIN (SELECT conv_id, turn, max(head) AS head FROM placed GROUP BY 1, 2) u ON u.conv_id = p.conv_id AND u.turn = p.attach WHERE p.attach IS NOT NULL
), path AS (
  SELECT conv_id, head, [(-attach, head)] AS path FROM br WHERE up IS NULL
  UNION ALL SELECT b.conv_id, b.head, list_append(p.path, (-b.attach, b.head)) FROM br b JOIN path p ON b.conv_id = p.conv_id AND b.up = p.head
), pos AS (
  SELECT p.conv_id, p.turn, p.ord, coalesce(p.head, -1) AS branch, row_number() OVER (PARTITION BY p.conv_id ORDER BY coalesce(t.path, []), p.turn, p.ord) - 1 AS position
  FROM placed p LEFT JOIN path t ON p.conv_id = t.conv_id AND p.head = t.head
)
SELECT o.conv_id, o.turn, o.role, o.own AS text, CAST(coalesce(a.n_quotes, 0) AS BIGINT) AS n_quotes, CAST(coalesce(a.depth, 0) AS BIGINT) AS depth,
       CAST(coalesce(a.n_linked, 0) AS BIGINT) AS n_linked, a.own_parent AS quoted_turn, CAST(p.branch AS BIGINT) AS branch, CAST(p.position AS BIGINT) AS position
FROM own o LEFT JOIN par a ON (o.conv_id, o.turn, o.ord) IS NOT DISTINCT FROM (a.conv_id, a.turn, a.ord)
LEFT JOIN pos p ON (o.conv_id, o.turn, o.ord) IS NOT DISTINCT FROM (p.conv_id, p.turn, p.ord)
"""


#: Fixed value: replies made of the conversations, each quoting the message one to three turns before it: all of its text,
#: all but its first line, its first paragraph with a line no one wrote, or nothing.
QUOTING = r"""
SELECT a.conv_id, a.turn, a.role, CASE WHEN b.text IS NULL OR a.turn % 4 = 3 THEN a.text ELSE
  '> ' || replace(CASE a.turn % 4 WHEN 0 THEN b.text WHEN 1 THEN regexp_replace(b.text, '^[^\n]*\n', '') ELSE split_part(b.text, chr(10), 1) || chr(10) || 'a line no one wrote' END, chr(10), chr(10) || '> ') || chr(10) || a.text END AS text
FROM {table} a LEFT JOIN {table} b ON a.conv_id = b.conv_id AND b.turn = a.turn - 1 - a.turn % 3
"""


def quoted_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``op1_quotation_linking`` on replies that quote: whole messages, parts of them and altered ones."""
    made = spark.sql(QUOTING.format(table="{conversations}").replace(r"'^[^\n]*\n'", r"'^[^\\n]*\\n'"), conversations=spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return reply_order(made)


QUOTED_THREADS_SQL = OP1_SQL.replace("WITH RECURSIVE msg AS (", f"WITH RECURSIVE threads AS ({QUOTING.format(table='conversations')}), msg AS (").replace("AS text FROM conversations", "AS text FROM threads")

#: The formatted conversations of the query above.
CHATS_SQL = f"""WITH o AS ({OP1_SQL}) SELECT conv_id, position // 256 AS part, string_agg('<|' || coalesce(role, '') || '|>' || chr(10) || text, chr(10) ORDER BY position) AS chat
FROM o WHERE position IS NOT NULL GROUP BY conv_id, position // 256"""
