"""Top-k similarity join: many profiles against all vectors, in blocks of a matrix product.

Vectors stay where they are read; profiles go out in blocks of ``block`` rows, one block on the
driver at a time and one pass over the vectors each.  A task multiplies each batch of vectors with the
block, keeps each profile's ``k`` best so far and drops what is below them; what tasks keep is
reduced in two steps of windows.

Defined cases: vectors and profiles that are null, of another length than the first profile, or not
finite are left out; a zero vector is like nothing under cosine (score 0); equal scores go by ascending id;
``block`` and ``k`` bound memory, not results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fernloom.functions.ranking import fit_key
from fernloom.registry import Tables, query
from fernloom.scratch import materialize

#: Decimals of a score: sums in another order differ beyond them.
DECIMALS = 9


def _matrix(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the right length with finite values, as doubles, and which they are."""
    good = np.array([len(v) == width if v.is_valid else False for v in column], bool)
    kept = column.filter(pa.array(good))
    flat = kept.flatten() if len(kept) else pa.array([], pa.float64())
    rows = flat.cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, width)
    finite = np.isfinite(rows).all(axis=1)
    return rows[finite], np.flatnonzero(good)[finite]


def _unit(rows: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, norms, out=np.zeros_like(rows), where=norms > 0)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        may = np.flatnonzero(scores >= least)
    else:
        may = np.arange(len(scores))
    return may[np.lexsort((ids[may], -scores[may]))[:k]]


def _multiplying(shared, k: int, cosine: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiles: np.ndarray = shared.value
        kept_scores = [np.empty(0)] * len(profiles)
        kept_ids = [np.empty(0, np.int64)] * len(profiles)
        for batch in batches:
            rows, which = _matrix(batch.column(1), profiles.shape[1])
            if not len(rows):
                continue
            ids = batch.column(0).cast(pa.int64()).to_numpy(zero_copy_only=False)[which]
            scores = np.round((_unit(rows) if cosine else rows) @ profiles.T, DECIMALS)
            for p in range(len(profiles)):
                own = scores[:, p]
                at = np.flatnonzero(own >= kept_scores[p][-1]) if len(kept_scores[p]) == k else np.arange(len(own))
                if len(at):
                    s, i = np.concatenate([kept_scores[p], own[at]]), np.concatenate([kept_ids[p], ids[at]])
                    top = _best(s, i, k)
                    kept_scores[p], kept_ids[p] = s[top], i[top]
        number = np.repeat(np.arange(len(profiles), dtype=np.int32), [len(s) for s in kept_scores])
        part = np.full(len(number), TaskContext.get().partitionId() % 64, np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(number), pa.array(part), pa.array(np.concatenate(kept_ids)), pa.array(np.concatenate(kept_scores))], ["number", "part", "id", "score"])

    return run


def nearest(vectors: DataFrame, profiles: DataFrame, k: int = 10, block: int = 2048, cosine: bool = True) -> DataFrame:
    """``(profile_id, place, id, score)``: each profile's ``k`` best of ``(id, vector)``, for all of ``(profile_id, vector)``."""
    spark = vectors.sparkSession
    kind, own = vectors.schema["id"].dataType.simpleString(), profiles.schema["profile_id"].dataType.simpleString()
    schema = f"profile_id {own}, place int, id {kind}, score double"
    first = profiles.where("vector IS NOT NULL").select(F.size("vector")).first()
    out = spark.createDataFrame([], schema)
    if first is None or not first[0]:
        return out
    asked = profiles.where(F.size("vector") == first[0]).select("profile_id", F.transform("vector", lambda x: x.cast("double")).alias("vector"))
    blocks = max(1, -(-asked.count() // block))
    of_block = F.pmod(F.xxhash64("profile_id"), F.lit(blocks))
    for b in range(blocks):
        rows = asked.where(of_block == b).orderBy("profile_id").collect()  # about ``block`` rows
        matrix = np.array([r["vector"] for r in rows], np.float64).reshape(-1, first[0])
        fine = np.isfinite(matrix).all(axis=1)
        names = [r["profile_id"] for r, ok in zip(rows, fine, strict=True) if ok]
        if not names:
            continue
        shared = spark.sparkContext.broadcast(_unit(matrix[fine]) if cosine else matrix[fine])
        found = vectors.select(F.col("id").cast("long").alias("id"), "vector").where("id IS NOT NULL").mapInArrow(_multiplying(shared, k, cosine), "number int, part int, id long, score double")
        order = [F.col("score").desc(), F.col("id")]
        for by in (["number", "part"], ["number"]):  # best of the tasks of a part, then of the parts
            found = found.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("place") <= k)
        numbered = spark.createDataFrame([(n, i) for i, n in enumerate(names)], f"profile_id {own}, number int")
        out = out.unionByName(materialize(found.join(numbered, "number").select("profile_id", "place", F.col("id").cast(kind).alias("id"), "score"), "nearest", keep=True))
    return out


@query("w_fit_batch", """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), u AS (SELECT vec_id, e, sqrt(list_inner_product(e, e)) AS n FROM v),
  s AS (SELECT a.vec_id AS profile_id, b.vec_id AS id, round(list_inner_product(a.e, b.e) / (a.n * b.n), 9) AS score FROM u a, u b),
  r AS (SELECT *, row_number() OVER (PARTITION BY profile_id ORDER BY score DESC, id) AS place FROM s)
  SELECT profile_id, CAST(place AS INTEGER) AS place, id, round(score, 6) AS score, CAST(2097152 + floor((greatest(-1.0::DOUBLE, least(1.0::DOUBLE, score)) + 1) / 2 * 2097151 + 0.5) AS BIGINT) AS key FROM r WHERE place <= 10""")
def fit_batch(t: Tables) -> DataFrame:
    """Every vector as a profile: its ten nearest of all vectors, with the order key of a fit."""
    vectors = t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    found = nearest(vectors, vectors.withColumnRenamed("id", "profile_id"))
    return found.select("profile_id", "place", "id", F.round("score", 6).alias("score"), fit_key(F.col("score")).cast("long").alias("key"))
