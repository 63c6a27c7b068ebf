"""Dictionaries of aliases found in whole texts: one automaton per worker, longest alias first.

A dictionary is a table ``(alias, id)`` with optional ``raw`` (the alias's letters must stand as
written) and ``needs`` (any of these words must stand in the same line).  Its aliases become a trie
of words with failure links (Aho-Corasick), built once a worker; a text is walked once, whatever
the number of aliases.  Of the matches the leftmost wins, of those that begin at one word the
longest that its rules allow, and each word is used once; an alias never runs over a line.

A dictionary of at most ``most`` aliases goes out as one automaton.  A larger one is dealt into parts
by alias, each with an automaton of its own and a pass over the texts; all matches of a text then
meet in one fold, so the size of a dictionary never bounds what is found.

Defined cases: null and empty texts have no matches; an alias without a word is left out; of ids
that share an alias the smallest wins; texts may repeat, their matches are found apiece.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fernloom.registry import Tables, query
from fernloom.scratch import materialize

#: A word is a run of letters, digits and the symbols that names are written with.
WORD = regex.compile(r"[\p{L}\p{N}+#]+")
MATCH = "array<struct<pos int, len int, id string, alias string, line int>>"
#: Aliases in one automaton, and texts' bytes held beside it.
MOST = 500_000


class Automaton:
    """The words of many aliases, looked for at once."""

    def __init__(self, rows: list[tuple]):
        self.number: dict[str, int] = {}
        by_words: dict[tuple[int, ...], list[tuple]] = {}
        for alias, id_, raw, needs in rows:
            written = WORD.findall(alias or "")
            if written:
                key = tuple(self.number.setdefault(w.lower(), len(self.number) + 1) for w in written)
                by_words.setdefault(key, []).append((id_, alias, tuple(written) if raw else None, frozenset(x.lower() for x in needs) if needs else None))
        self.machine = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for key, entries in by_words.items():
            entries.sort(key=lambda e: (e[0], e[1]))
            self.machine.add_word(key, (len(key), entries))
        self.machine.make_automaton()
        self.empty = not by_words

    def found(self, text: str | None) -> Iterator[tuple[int, int, str, str, int]]:
        """All matches whose rules hold, ``(first word, words, id, alias, line)``; the same words give the smallest id."""
        if self.empty or not text:
            return
        before = 0
        for number, line in enumerate(text.split("\n")):
            words = WORD.findall(line)
            lower = [w.lower() for w in words]
            codes = tuple(self.number.get(w, 0) for w in lower)
            here = None
            for end, (n, entries) in self.machine.iter(codes):
                first = end - n + 1
                for id_, alias, written, needs in entries:
                    if written and tuple(words[first : end + 1]) != written:
                        continue
                    if needs:
                        here = frozenset(lower) if here is None else here
                        if not needs & here:
                            continue
                    yield before + first, n, id_, alias, number
                    break
            before += len(words)


def leftmost_longest(matches: list[tuple]) -> list[tuple]:
    """Matches from left to right, the longest of each place (then the smallest id), no word used twice."""
    out, free = [], 0
    for m in sorted(matches, key=lambda m: (m[0], -m[1], m[2], m[3])):
        if m[0] >= free:
            out.append(m)
            free = m[0] + m[1]
    return out


def _normal(dictionary: DataFrame) -> DataFrame:
    raw = F.col("raw") if "raw" in dictionary.columns else F.lit(False)
    needs = F.col("needs") if "needs" in dictionary.columns else F.lit(None)
    return dictionary.select("alias", F.col("id").cast("string").alias("id"), F.coalesce(raw, F.lit(False)).alias("raw"), needs.cast("array<string>").alias("needs")).where("alias IS NOT NULL AND id IS NOT NULL").distinct()


def _walk(df: DataFrame, column: str, rows: list[tuple], resolve: bool) -> DataFrame:
    shared, at = df.sparkSession.sparkContext.broadcast(rows), df.columns.index(column)
    schema = T.StructType([*df.schema.fields, T.StructField("matches", T.DataType.fromDDL(MATCH))])
    kind = pa.list_(pa.struct([("pos", pa.int32()), ("len", pa.int32()), ("id", pa.string()), ("alias", pa.string()), ("line", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(shared.value)
        names = ("pos", "len", "id", "alias", "line")
        for batch in batches:
            out = []
            for text in batch.column(at):
                found = list(automaton.found(text.as_py()))
                out.append([dict(zip(names, m, strict=True)) for m in (leftmost_longest(found) if resolve else found)])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, kind)], [*batch.schema.names, "matches"])

    return df.mapInArrow(run, schema)


def scan(df: DataFrame, column: str, dictionary: DataFrame, most: int = MOST) -> DataFrame:
    """``df`` plus ``matches``: what the dictionary finds in a text column."""
    df, dictionary = df.drop("matches"), _normal(dictionary)
    aliases = materialize(dictionary, "aliases")
    parts = max(1, -(-aliases.count() // most))
    if parts == 1:
        return _walk(df, column, [tuple(r) for r in aliases.collect()], True)  # at most ``most`` rows
    # the parts split by alias, so a place's matches of several parts meet again below
    texts = materialize(df.withColumn("_row", F.monotonically_increasing_id()), "texts")
    each = None
    for p in range(parts):
        rows = [tuple(r) for r in aliases.where(F.pmod(F.xxhash64("alias"), F.lit(parts)) == p).collect()]  # about ``most`` rows
        found = _walk(texts.select("_row", column), column, rows, False).select("_row", F.explode("matches").alias("m"))
        each = found if each is None else each.unionByName(found)
    lists = each.groupBy("_row").agg(F.collect_list("m").alias("all"))

    @F.arrow_udf(T.DataType.fromDDL(MATCH))
    def resolve(lists: pa.Array) -> pa.Array:
        names = ("pos", "len", "id", "alias", "line")
        return pa.array([[dict(zip(names, m, strict=True)) for m in leftmost_longest([tuple(x[n] for n in names) for x in ms.as_py() or []])] for ms in lists], lists.type)

    return texts.join(lists, "_row", "left").select(*df.columns, resolve(F.coalesce("all", F.array().cast(MATCH))).alias("matches"))


_WORDS = "regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}+#]+')"
#: A dictionary of the items' first words, alone if long, by two and by three.
_DICTIONARY = f"""SELECT DISTINCT array_to_string(w[1:n], ' ') AS alias, min(CAST(item_id AS VARCHAR) || ':' || CAST(n AS VARCHAR)) AS id
  FROM (SELECT item_id, {_WORDS.format('text')} AS w FROM benchmark), (VALUES (1), (2), (3)) v(n) WHERE len(w) >= 3 AND (n > 1 OR length(w[1]) >= 5) GROUP BY alias"""


def item_phrases(t: Tables) -> DataFrame:
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}+#]+"), F.lit(0))
    rows = t.benchmark.select("item_id", words.alias("w")).where("size(w) >= 3").select("item_id", "w", F.explode(F.array(*[F.lit(n) for n in (1, 2, 3)])).alias("n"))
    kept = rows.where((F.col("n") > 1) | (F.length(F.get("w", F.lit(0))) >= 5))
    return kept.select(F.array_join(F.slice("w", F.lit(1), F.col("n")), " ").alias("alias"), F.concat_ws(":", "item_id", "n").alias("id")).groupBy("alias").agg(F.min("id").alias("id"))


@query("d_scan_skills", f"""WITH RECURSIVE a AS ({_DICTIONARY}), k AS (SELECT id, alias, string_split(alias, ' ') AS ws FROM a),
  l AS (SELECT doc_id, i AS line, {_WORDS.format('line')} AS w FROM (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))),
  b AS (SELECT *, sum(len(w)) OVER (PARTITION BY doc_id ORDER BY line) - len(w) AS before FROM l),
  p AS (SELECT doc_id, line, before, w, unnest(w) AS first, generate_subscripts(w, 1) AS i FROM b),
  m AS (SELECT doc_id, CAST(before + i - 1 AS BIGINT) AS pos, len(ws) AS n, arg_max(id, len(ws)) AS id FROM p JOIN k ON first = ws[1] AND w[i:i + len(ws) - 1] = ws GROUP BY doc_id, before, i, len(ws)),
  s AS (SELECT doc_id, pos, max(n) AS n, arg_max(id, n) AS id FROM m GROUP BY doc_id, pos),
  g AS (SELECT doc_id, min(pos) AS pos FROM s GROUP BY doc_id
    UNION ALL SELECT g.doc_id, (SELECT min(x.pos) FROM s x WHERE x.doc_id = g.doc_id AND x.pos >= g.pos + y.n) FROM g JOIN s y ON y.doc_id = g.doc_id AND y.pos = g.pos WHERE g.pos IS NOT NULL)
  SELECT doc_id, CAST(pos AS INTEGER) AS pos, CAST(n AS INTEGER) AS words, id AS skill FROM g JOIN s USING (doc_id, pos)""")
def scan_skills(t: Tables) -> DataFrame:
    """Phrases of the items in whole documents: place, words, and the item and length that name them."""
    found = scan(t.documents.select("doc_id", "text"), "text", item_phrases(t))
    return found.select("doc_id", F.explode("matches").alias("m")).select("doc_id", "m.pos", F.col("m.len").alias("words"), F.col("m.id").alias("skill"))


def _part_kinds(t: Tables) -> DataFrame:
    return t.spark.createDataFrame([("red widget", "widgets"), ("widget", "hardware"), ("small ring", "jewels"), ("ring", "jewels")], "alias string, id string")


@query("d_scan_industries", "SELECT DISTINCT p_name, CASE WHEN p_name = 'red widget' THEN ['widgets'] WHEN p_name LIKE '%widget' THEN ['hardware'] WHEN p_name LIKE '%ring' THEN ['jewels'] ELSE [] END AS industries FROM part")
def scan_industries(t: Tables) -> DataFrame:
    names = t.part.select("p_name").distinct()
    return scan(names, "p_name", _part_kinds(t)).select("p_name", F.transform("matches", lambda m: m["id"]).alias("industries"))


@query("u_skill_dictionary", "SELECT p_partkey, CAST(0 AS INT) AS pos, CASE WHEN p_name LIKE '%red widget' THEN 'widgets' WHEN p_name LIKE '%widget' THEN 'hardware' ELSE 'jewels' END AS skill FROM part WHERE p_name LIKE '%widget' OR p_name LIKE '%ring'")
def u_skills(t: Tables) -> DataFrame:
    """The dictionary's ``extract``: the skills of a text, numbered."""
    found = scan(t.part.select("p_partkey", "p_name"), "p_name", _part_kinds(t))
    return found.select("p_partkey", F.posexplode(F.transform("matches", lambda m: m["id"])).alias("pos", "skill"))


@query("u_skill_canonical", f"""WITH a AS ({_DICTIONARY}) SELECT doc_id, id AS canonical FROM documents JOIN a ON array_to_string({_WORDS.format('text')}, ' ') = alias
  UNION ALL SELECT item_id, id FROM (SELECT item_id, array_to_string(({_WORDS.format('text')})[1:2], ' ') AS term FROM benchmark) JOIN a ON term = alias""")
def u_canonical(t: Tables) -> DataFrame:
    """The dictionary's ``canonical``: the id of a whole term, case and punctuation relaxed."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}+#]+"), F.lit(0))
    asked = t.documents.select("doc_id", F.array_join(words, " ").alias("alias")).unionAll(t.benchmark.select("item_id", F.array_join(F.slice(words, 1, 2), " ")))
    return asked.join(item_phrases(t), "alias").select("doc_id", F.col("id").alias("canonical"))
