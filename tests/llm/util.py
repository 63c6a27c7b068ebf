"""Helpers: frames with nulls, clashing extra columns, repeats; DuckDB beside Spark."""

import duckdb
import pandas as pd

LONG = "word " * 20_000
TEXTS = [None, "", " ", "one", "a\nb\n", LONG, "same line that is long enough\nx", "Same line that is long ENOUGH \ny", "same line that is long enough", "é ü 漢字 🤖", "same line that is long enough\nx"]


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def documents(spark, texts=TEXTS, first_id=0):
    """Documents with extra columns whose names clash with columns operators make."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, fp long, shard int, spans string, label string, score double"
    rows = [(first_id + i, t, "en", None, None if t is None else len(t), None, None, None, None, None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, schema)


def oracle(sql, **tables):
    """Rows of ``sql`` over pandas frames, as a set-like sorted list of tuples by column name."""
    con = duckdb.connect()
    for name, df in tables.items():
        con.register(f"__{name}", df)
        con.execute(f"CREATE TABLE {name} AS SELECT * FROM __{name}")
    return rows_of(con.execute(sql).fetchdf())


def rows_of(pdf: pd.DataFrame):
    pdf = pdf[sorted(pdf.columns)]
    return sorted((tuple(None if pd.isna(x) else x for x in r) for r in pdf.itertuples(index=False)), key=repr)


def typed(pdf, **kinds):
    for c, k in kinds.items():
        pdf[c] = pdf[c].astype(k)
    return pdf
