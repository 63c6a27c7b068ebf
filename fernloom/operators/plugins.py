"""Registered functions, table functions and data sources."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from fernloom.functions import text
from fernloom.operators import domain
from fernloom.plans.postings import JOBS, jobs
from fernloom.registry import Tables, query


def _company_key(names: pd.Series) -> pd.Series:
    plain = names.str.lower().str.replace(r"\([^)]*\)", " ", regex=True).str.replace("[^a-z0-9]+", " ", regex=True).str.strip()
    return plain.str.replace(rf"(?: (?:{text.LEGAL}))+$", "", regex=True)


def _family(titles: pd.Series) -> pd.Series:
    def best(title: str) -> str | None:
        ws = "".join(c if c.isalnum() else " " for c in title.lower()).split()
        found = [(len(p), i, f) for p, f in domain.FAMILIES for i in range(len(ws)) if ws[i : i + len(p.split())] == p.split()]
        return max(found)[2] if found else None

    return titles.map(best)


def _place(locations: pd.Series, wanted: pd.Series) -> pd.Series:
    return pd.Series([any(all(w in s.lower() for w in q.lower().split(", ")) for s in x.split(";")) for x, q in zip(locations, wanted, strict=True)])


def register(spark: SparkSession) -> None:
    """SQL functions fl_company_key, fl_title_family and fl_place_match, vectorised."""
    spark.udf.register("fl_company_key", F.pandas_udf(_company_key, "string"))
    spark.udf.register("fl_title_family", F.pandas_udf(_family, "string"))
    spark.udf.register("fl_place_match", F.pandas_udf(_place, "boolean"))


@query("u_sql_company_key", "SELECT s_suppkey, trim(regexp_replace(lower(s_name), '[^a-z0-9]+', ' ', 'g')) AS key FROM supplier")
def u_company_key(t: Tables) -> DataFrame:
    register(t.spark)
    return t.spark.sql("SELECT s_suppkey, fl_company_key(concat(s_name, ' Inc.')) AS key FROM {s}", s=t.supplier)


@query("u_sql_title_family", f"{JOBS} SELECT DISTINCT title, CASE title WHEN 'Senior Data Engineer' THEN 'data' WHEN 'Engineering Manager' THEN 'management' WHEN 'Registered Nurse II' THEN 'nursing' WHEN 'Lead Analyst, 2024 Summer' THEN 'analysis' WHEN 'Recruiter' THEN 'people' WHEN 'Director of Data' THEN 'data' ELSE 'engineering' END AS family FROM jobs")
def u_title_family(t: Tables) -> DataFrame:
    register(t.spark)
    return t.spark.sql("SELECT title, fl_title_family(title) AS family FROM {j}", j=jobs(t).select("title").distinct())


@query("u_sql_place_match", f"{JOBS} SELECT DISTINCT country, country = 'NATION_5' AS fits FROM jobs")
def u_place_match(t: Tables) -> DataFrame:
    register(t.spark)
    return t.spark.sql("SELECT country, fl_place_match(concat('x; ', country, ', ', area), 'Nation_5, Africa') AS fits FROM {j}", j=jobs(t).select("country", "area").distinct())


def embed(column: Column, dims: int = 64) -> Column:
    """Hashed bag of words of unit length: the embedder's interface without a model, one set-up a worker."""

    def run(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
        places: dict[str, int] = {}
        for texts in columns:
            out = []
            for s in texts:
                v = np.zeros(dims, np.float32)
                for w in (s or "").lower().split():
                    place = places.get(w)
                    if place is None:
                        place = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=4).digest(), "big") % dims
                        if len(places) < 100_000:  # a full cache only costs time
                            places[w] = place
                    v[place] += 1
                out.append(v / max(float(np.linalg.norm(v)), 1e-9))
            yield pd.Series(out)

    run.__annotations__ = {"columns": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "array<float>")(column)


@query("u_embedder")
def u_embedder(t: Tables) -> DataFrame:
    return t.benchmark.select("item_id", embed(F.col("text")).alias("embedding"))


class _Board(InputPartition):
    def __init__(self, name: str, rows: int):
        super().__init__(name)
        self.name, self.rows = name, rows


class _BoardReader(DataSourceReader):
    def __init__(self, options: dict):
        self.boards, self.rows = options.get("boards", "a").split(","), int(options.get("rows", "10"))

    def partitions(self):
        return [_Board(b, self.rows) for b in self.boards]

    def read(self, partition):
        for i in range(partition.rows):
            yield partition.name, f"{partition.name}-{i}", f'{{"id": {i}, "absolute_url": "https://x.org/{i}", "title": "T{i}"}}'


class BoardSource(DataSource):
    """A source plug-in: one partition a board; an adapter overrides ``read``."""

    @classmethod
    def name(cls) -> str:
        return "fernloom_boards"

    def schema(self) -> str:
        return "board string, external_id string, payload string"

    def reader(self, schema) -> DataSourceReader:
        return _BoardReader(dict(self.options))


@query("u_source_adapter", "SELECT b AS board, 25::BIGINT AS n FROM (VALUES ('a'), ('b'), ('c')) v(b)")
def u_source(t: Tables) -> DataFrame:
    t.spark.dataSource.register(BoardSource)
    rows = t.spark.read.format("fernloom_boards").option("boards", "a,b,c").option("rows", "25").load()
    return rows.groupBy("board").agg(F.count("*").alias("n"))


@query("u_feed_adapter", "SELECT 'T' || CAST(i AS STRING) AS title FROM range(5) r(i)")
def u_feed(t: Tables) -> DataFrame:
    """A feed plug-in's payloads through the board mappers."""
    from fernloom.sources.boards import any_board

    t.spark.dataSource.register(BoardSource)
    rows = t.spark.read.format("fernloom_boards").option("boards", "feed").option("rows", "5").load()
    return rows.select(any_board(F.col("payload"))["title"].alias("title"))


#: Default weights of the match score; overrides are checked against them.
WEIGHTS = {"base": 36.0, "experience": 0.24, "skills": 0.29, "industry": 0.08}


def match_config(overrides: dict | None = None) -> dict:
    """Weights with overrides, and a version that names them."""
    wrong = {k for k, v in (overrides or {}).items() if k not in WEIGHTS or not isinstance(v, (int, float)) or v < 0}
    if wrong:
        raise ValueError(f"not weights: {sorted(wrong)}")
    out = {**WEIGHTS, **(overrides or {})}
    return {**out, "version": hashlib.sha256(repr(sorted(out.items())).encode()).hexdigest()[:12]}


@query("u_match_config", "SELECT 'base' AS name, 36.0::DOUBLE AS value UNION ALL SELECT 'experience', 0.24 UNION ALL SELECT 'skills', 0.5 UNION ALL SELECT 'industry', 0.08")
def u_match_config(t: Tables) -> DataFrame:
    c = match_config({"skills": 0.5})
    return t.spark.createDataFrame([(k, float(c[k])) for k in WEIGHTS], "name string, value double")


def tools() -> dict:
    """Read-only named queries an assistant may call; each gives a DataFrame."""
    from fernloom.registry import QUERIES

    names = {"search_jobs": "search_first_page", "list_tracker": "j_tracker_list", "get_match": "d_compute_match", "list_boards": "f_board_view", "coverage": "a_coverage_report", "contacts": "f_contacts_list", "company": "x_company_detail", "activity": "a_activity_by_day", "trend": "a_period_trend", "reminders": "a_due_reminders", "sponsors": "a_h1b_summarize", "health": "x_health_report"}
    return {tool: QUERIES[q] for tool, q in names.items()}


@query("u_assistant_tools", "SELECT count(*) AS n FROM (SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'P' GROUP BY 1)")
def u_tools(t: Tables) -> DataFrame:
    return tools()["list_tracker"](t.spark, t.sf_dir).agg(F.count("*").alias("n"))
