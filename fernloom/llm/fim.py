"""Fill-in-middle: two random cuts at token ends, found by counting boundaries in overlapping chunks.

A token is white space and the word after it, or the white space that ends a text; so a token
ends where a non-blank byte stands before a blank one, and at the text's end.  The blanks are
ASCII, so bytes decide as code points do.  A text of ``chunk`` bytes or less is one chunk and
holds both its cuts.  A longer text is cut into chunks of ``chunk`` bytes that overlap by one
byte, dealt over the tasks; each counts its boundaries, a window sums them up along the text,
and each cut rank is routed to the one chunk whose range of ranks has it.  Only these chunks are
read again, and only the texts of more than one chunk are shuffled.

Defined cases: a null or empty text is an empty plain document; a null id seeds with the empty
string; rows that repeat id and text get the same result each, rows that share only the id are
told apart by the text; other columns are passed through (``output``, ``form``, ``n_tokens``,
``prefix_chars`` and ``middle_chars`` are replaced); an empty table gives an empty result.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fernloom.llm.batches import bytes_of, small_batches

#: The sentinels, and the bytes that count as white space.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
BLANKS = b" \t\n\x0b\x0c\r"
MADE = ("output", "form", "n_tokens", "prefix_chars", "middle_chars")
#: Bytes of a chunk.
CHUNK = 1 << 15

#: Types as objects: parsing a type's text needs a running session.
CUTS = T.StructType([T.StructField(c, T.LongType()) for c in ("n_tokens", "cut1", "cut2")])

_BLANK = np.zeros(256, bool)
_BLANK[list(BLANKS)] = True


def boundaries(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Places of all boundaries inside rows (a blank byte after another), and each row's first index in them."""
    data, offsets = bytes_of(column)
    blank = _BLANK[data]
    at = np.flatnonzero(blank[1:] & ~blank[:-1]) + 1
    starts = np.zeros(len(data) + 1, bool)
    starts[offsets] = True  # between two rows there is no boundary
    at = at[~starts[at]]
    return at, np.searchsorted(at, offsets)


@F.arrow_udf(T.LongType())
def _count(chunk: pa.Array) -> pa.Array:
    return pa.array(np.diff(boundaries(chunk)[1]).astype(np.int64))


@F.arrow_udf(T.LongType())
def _place(chunk: pa.Array, rank: pa.Array) -> pa.Array:
    """Bytes before the ``rank``-th boundary (from 1) of each chunk."""
    at, first = boundaries(chunk)
    offsets = bytes_of(chunk)[1]
    return pa.array(at[first[:-1] + rank.to_numpy(zero_copy_only=False) - 1] - offsets[:-1])


@F.arrow_udf(CUTS)
def _cut_whole(text: pa.Array, h1: pa.Array, h2: pa.Array) -> pa.Array:
    """Token count and both cuts, in bytes, of texts of one chunk."""
    data, offsets = bytes_of(text)
    at, first = boundaries(text)
    n = np.diff(first) + (np.diff(offsets) > 0)
    ranks = np.sort(np.stack([h.to_numpy(zero_copy_only=False) % (n + 1) for h in (h1, h2)]), axis=0)
    at = np.append(at, 0)  # so that an index past the last boundary exists
    cuts = [np.where(r == 0, 0, np.where(r == n, np.diff(offsets), at[np.clip(first[:-1] + r - 1, 0, len(at) - 1)] - offsets[:-1])) for r in ranks]
    return pa.StructArray.from_arrays([pa.array(x.astype(np.int64)) for x in (n, *cuts)], ["n_tokens", "cut1", "cut2"])


def cut_in_place(rows: DataFrame) -> DataFrame:
    """``_text``, ``_h1``, ``_h2`` plus struct ``_cut`` where a text is its own only chunk."""
    return rows.withColumn("_cut", _cut_whole("_text", "_h1", "_h2"))


def cut_by_chunks(rows: DataFrame, key: list[str], chunk: int) -> DataFrame:
    """The same for texts of any length: counts per chunk, prefix sums, ranks routed to the owning chunks.

    Rows equal in ``key`` have equal texts and hashes.
    """
    utf8 = F.encode("_text", "UTF-8")
    last = ((F.octet_length("_text") - 1) / chunk).cast("int")
    numbered = F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(i.alias("no"), F.substring(utf8, i * chunk + 1, F.lit(chunk + 1)).alias("bytes")))
    sizes = F.octet_length("_text").cast("long").alias("size")
    dealt = rows.select(*key, sizes, "_h1", "_h2", F.explode(numbered).alias("c")).select(*key, "size", "_h1", "_h2", "c.no", "c.bytes")
    dealt = dealt.repartition(*key, "no")  # one text's chunks go to many tasks
    counted = dealt.select(*key, "size", "_h1", "_h2", "no", _count("bytes").alias("n"))
    counted = counted.groupBy(*key, "no").agg(*[F.max(c).alias(c) for c in ("size", "_h1", "_h2", "n")])  # repeated rows are one
    along = Window.partitionBy(*key)
    sums = counted.withColumn("upto", F.sum("n").over(along.orderBy("no"))).withColumn("n_tokens", F.sum("n").over(along) + 1)
    r1, r2 = F.pmod("_h1", F.col("n_tokens") + 1), F.pmod("_h2", F.col("n_tokens") + 1)

    def owner(rank: Column) -> Column:
        """This chunk and the rank inside it, if the chunk has the boundary of ``rank``."""
        inside = (rank > F.col("upto") - F.col("n")) & (rank <= F.col("upto"))
        return F.max(F.when(inside, F.struct("no", (rank - F.col("upto") + F.col("n")).alias("rank"))))

    routed = sums.withColumns({"lo": F.least(r1, r2), "hi": F.greatest(r1, r2)}).groupBy(*key).agg(
        *[F.max(c).alias(f"_{c}") for c in ("n_tokens", "lo", "hi", "size")], owner(F.col("lo")).alias("_own1"), owner(F.col("hi")).alias("_own2")
    )
    names = [f"_k{i}" for i in range(len(key))]
    routed = routed.withColumnsRenamed(dict(zip(key, names, strict=True)))
    both = rows.join(routed, [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(key, names, strict=True)]).drop(*names)

    def cut(rank: str, own: str) -> Column:
        """Byte position of a rank: no bytes, all of them, or the owning chunk's start and the place found there."""
        piece = F.substring(utf8, F.coalesce(F.col(f"{own}.no"), F.lit(0)) * chunk + 1, F.lit(chunk + 1))
        found = F.col(f"{own}.no") * F.lit(chunk).cast("long") + _place(F.when(F.col(own).isNotNull(), piece).otherwise(F.lit(b" .a ")), F.coalesce(F.col(f"{own}.rank"), F.lit(1).cast("long")))
        return F.when(F.col(rank) == 0, F.lit(0).cast("long")).when(F.col(rank) == F.col("_n_tokens"), F.col("_size")).otherwise(found)

    return both.withColumn("_cut", F.struct(F.col("_n_tokens").alias("n_tokens"), cut("_lo", "_own1").alias("cut1"), cut("_hi", "_own2").alias("cut2"))).drop(
        "_n_tokens", "_lo", "_hi", "_size", "_own1", "_own2"
    )


def fill_in_middle(docs: DataFrame, chunk: int = CHUNK, seed: int = 42, percent: int = 50, spm_percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` plus ``output``, ``form`` (plain, psm, spm), ``n_tokens`` and the chars of prefix and middle.

    ``percent`` of the documents are cut, ``spm_percent`` of these in the order suffix, prefix,
    middle; the choices hang on ``seed`` and the id alone.
    """
    if chunk < 1:
        raise ValueError("a chunk has a byte at least")
    docs = small_batches(docs).drop(*MADE)
    own = docs.columns
    digest = F.sha2(F.encode(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), "UTF-8"), 256)
    h1, h2, h3, h4 = (F.conv(F.substring("_digest", 8 * i + 1, 8), 16, 10).cast("long") for i in range(4))
    rows = docs.withColumn("_digest", digest).withColumns({"_text": F.coalesce(F.col(text_col), F.lit("")), "_h1": h1, "_h2": h2})
    marked = F.contains("_text", F.lit(PREFIX)) | F.contains("_text", F.lit(SUFFIX)) | F.contains("_text", F.lit(MIDDLE))
    form = F.when((F.col("_text") == "") | marked | (h3 % 100 >= percent), "plain").when(h4 % 100 < spm_percent, "spm").otherwise("psm")
    rows = rows.withColumn("form", form).drop("_digest")
    short = cut_in_place(rows.where(F.octet_length("_text") <= chunk))
    long = rows.where(F.octet_length("_text") > chunk).withColumn("_same", F.sha2(F.encode("_text", "UTF-8"), 256))
    cut = short.unionByName(cut_by_chunks(long, [id_col, "_same"], chunk).drop("_same"))

    utf8, c1, c2 = F.encode("_text", "UTF-8"), F.col("_cut.cut1").cast("int"), F.col("_cut.cut2").cast("int")
    prefix, middle, suffix = (F.decode(x, "UTF-8") for x in (F.substring(utf8, F.lit(1), c1), F.substring(utf8, c1 + 1, c2 - c1), F.substring(utf8, c2 + 1, F.octet_length("_text") - c2)))
    parts = cut.withColumns({"_p": prefix, "_m": middle, "_s": suffix})
    psm = F.concat(F.lit(PREFIX), "_p", F.lit(SUFFIX), "_s", F.lit(MIDDLE), "_m")
    spm = F.concat(F.lit(SUFFIX), "_s", F.lit(PREFIX), "_p", F.lit(MIDDLE), "_m")
    plain = F.col("form") == "plain"
    return parts.select(
        *own,
        F.when(plain, F.col("_text")).when(F.col("form") == "psm", psm).otherwise(spm).alias("output"),
        "form",
        F.col("_cut.n_tokens").alias("n_tokens"),
        F.when(~plain, F.length("_p").cast("long")).alias("prefix_chars"),
        F.when(~plain, F.length("_m").cast("long")).alias("middle_chars"),
    )


def restored(output: str, form: str) -> Column:
    """The text, rebuilt from an output and its form alone."""
    out = F.col(output)

    def between(a: str, b: str | None) -> Column:
        rest = F.split_part(out, F.lit(a), F.lit(2))
        return F.split_part(rest, F.lit(b), F.lit(1)) if b else rest

    psm = F.concat(between(PREFIX, SUFFIX), between(MIDDLE, None), between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), between(MIDDLE, None), between(SUFFIX, PREFIX))
    return F.when(F.col(form) == "plain", out).when(F.col(form) == "psm", psm).otherwise(spm)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query over all of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = fill_in_middle(docs)
    sha = lambda c: F.sha2(F.encode(c, "UTF-8"), 256)
    return out.select("doc_id", F.col("n_tokens").alias("n"), "form", "prefix_chars", "middle_chars", sha("output").alias("output_sha256"), sha(restored("output", "form")).alias("restored_sha256"))


OP11_SQL = r"""
WITH cut AS (
  SELECT doc_id, text, sha256('42:' || doc_id) AS sha,
         regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS tokens
  FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)
), ranked AS (
  SELECT doc_id, text, tokens, len(tokens) AS n,
         CAST('0x' || sha[1:8] AS BIGINT) % (len(tokens) + 1) AS a, CAST('0x' || sha[9:16] AS BIGINT) % (len(tokens) + 1) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR CAST('0x' || sha[17:24] AS BIGINT) % 100 >= 50 THEN 'plain'
              WHEN CAST('0x' || sha[25:32] AS BIGINT) % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM cut
), parts AS (
  SELECT doc_id, text, n, form, array_to_string(tokens[1:least(a, b)], '') AS p,
         array_to_string(tokens[least(a, b) + 1:greatest(a, b)], '') AS m, array_to_string(tokens[greatest(a, b) + 1:], '') AS s
  FROM ranked
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
       CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(CASE form WHEN 'plain' THEN text ELSE p || m || s END) AS restored_sha256
FROM parts
"""
