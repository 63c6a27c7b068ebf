"""Order keys, paging predicates and schedules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

EPOCH = "DATE '2000-01-01'"
FIT_STEPS = (1 << 21) - 1


def day_number(ts: Column) -> Column:
    """Day since 2000, from 1; unknown is 0."""
    return F.coalesce(F.date_diff(F.to_date(ts), F.expr(EPOCH)) + 1, F.lit(0))


def recommended_key() -> Column:
    """Fresh days first; within a day known pay 4, work model 2, level 1, place 1."""
    known = lambda c, n: F.when(F.col(c).isNotNull(), n).otherwise(0)
    return day_number(F.col("posted_at")) * 16 + known("currency", 4) + known("work_model", 2) + known("level", 1) + known("country", 1)


def fit_key(score: Column) -> Column:
    """A score in [-1, 1] on 2**21 steps (ties of the original scale are kept); unknown scores sort after all."""
    clamped = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), score))
    return F.when(score.isNotNull(), F.lit(1 << 21) + F.floor((clamped + 1) / 2 * FIT_STEPS + 0.5))


def after(frame: DataFrame, primary: str, tie: str, cursor: tuple) -> DataFrame:
    """Rows strictly after ``(primary, tie)`` in descending, nulls last, ascending order."""
    key, last = cursor
    if key is None:
        return frame.where(F.col(primary).isNull() & (F.col(tie) > last))
    k = F.lit(key)
    return frame.where(F.col(primary).isNull() | (F.col(primary) < k) | ((F.col(primary) == k) & (F.col(tie) > last)))


def retry_delay(failures: Column, ladder: list[int]) -> Column:
    """Delay of the n-th failure on a ladder; the last step repeats."""
    return F.element_at(F.array(*[F.lit(x) for x in ladder]), F.least(F.greatest(failures, F.lit(1)), F.lit(len(ladder))).cast("int"))


def fnv1a32(text: Column) -> Column:
    """32-bit FNV-1a of the UTF-8 bytes."""
    big = F.hex(F.encode(text, "UTF-8"))
    codes = F.transform(F.sequence(F.lit(1), F.octet_length(text)), lambda i: F.conv(F.substr(big, i * 2 - 1, F.lit(2)), 16, 10).cast("long"))
    step = lambda h, b: (h.bitwiseXOR(b) * F.lit(16777619)) % F.lit(1 << 32)
    return F.when(F.octet_length(text) > 0, F.aggregate(codes, F.lit(2166136261), step)).otherwise(F.lit(2166136261))


def rank_tiers(key: Column, query: str) -> Column:
    """Directory search: exact, prefix, word prefix, contains, else no match (null)."""
    return F.when(key == query, 0).when(key.startswith(query), 1).when(F.concat(F.lit(" "), key).contains(f" {query}"), 2).when(key.contains(query), 3)


def dominant(rows: DataFrame, by: list[str], weight: str, ratio: float, *tie: str) -> DataFrame:
    """The heaviest row of each key, flagged ambiguous unless it outweighs the next by ``ratio``."""
    w = Window.partitionBy(*by).orderBy(F.col(weight).desc(), *tie)
    ranked = rows.withColumns({"__n": F.row_number().over(w), "__next": F.lead(weight).over(w)})
    return ranked.where("__n = 1").withColumn("ambiguous", F.coalesce(F.col(weight) < ratio * F.col("__next"), F.lit(False))).drop("__n", "__next")
