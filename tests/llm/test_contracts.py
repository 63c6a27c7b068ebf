"""The registered queries on the smallest tables, each against its SQL or a brute-force version."""

import hashlib
import math
import zlib
from collections import Counter

import duckdb
import pytest

from fernloom.llm import queries
from tests.llm.test_linededup import brute as brute_lines
from tests.llm.test_maxent import held, tokens
from tests.llm.test_pii import brute as brute_spans
from tests.llm.test_simhash import brute_components, brute_fingerprint

LEAST = {
    "op2_simhash_near_dedup": {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
    "op3_min_cost_flow_reshard": {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"},
    "op4_matroska": {"doc_id": "bigint", "n_bytes": "bigint", "payload_bytes": "bigint", "payload_sha256": "string", "tail_crc32": "bigint", "media_bytes": "bigint", "media_sha256": "string", "feature": "string"},
    "op5_url_filter": {"page_id": "bigint", "host": "string", "path": "string", "rule": "string", "verdict": "string"},
    "op6_pii_spans": {"doc_id": "bigint", "n_email": "bigint", "n_ip": "bigint", "n_card": "bigint", "n_phone": "bigint", "base_sha256": "string", "spans": "string"},
    "op8_language_id": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op11_fill_in_middle": {"doc_id": "bigint", "n": "bigint", "form": "string", "prefix_chars": "bigint", "middle_chars": "bigint", "output_sha256": "string", "restored_sha256": "string"},
    "op12_maxent_scores": {"doc_id": "bigint", "held_out": "boolean", "n_tokens": "bigint", "n_known": "bigint", "train_tokens": "bigint", "base_score": "double", "score": "double"},
    "op13_ranked_search": {"item_id": "bigint", "rank": "int", "doc_id": "bigint", "score": "bigint"},
    "op10_line_dedup": {"doc_id": "bigint", "n_lines": "bigint", "n_dropped": "bigint", "kept_sha256": "string"},
}


@pytest.fixture(scope="module")
def texts(spark, sf):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def run(spark, sf):
    done = {}

    def get(name):
        if name not in done:
            df = queries.QUERIES[name](spark, sf)
            done[name] = (dict(df.dtypes), df.collect())
        return done[name]

    return get


@pytest.mark.parametrize("name", sorted(LEAST))
def test_columns_and_types(run, name):
    kinds, rows = run(name)
    assert {c: kinds.get(c) for c in LEAST[name]} == LEAST[name] and rows


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(run, sf, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    cursor = con.execute(queries.ORACLE_SQL[name])
    columns = [d[0] for d in cursor.description]
    kinds, rows = run(name)
    assert sorted(columns) == sorted(kinds)
    assert sorted((tuple(r[c] for c in columns) for r in rows), key=repr) == sorted(cursor.fetchall(), key=repr)


def test_op2(run, texts):
    fps = {i: brute_fingerprint(t) for i, t in texts.items()}
    roots = brute_components(fps)
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in run("op2_simhash_near_dedup")[1]} == {(i, f"{fps[i]:016x}", roots[i]) for i in texts}


def test_op3(run, texts):
    rows = run("op3_min_cost_flow_reshard")[1]
    assert {(r.doc_id, r.size, r.text_crc32) for r in rows} == {(i, len(t.encode()) + 1, zlib.crc32(t.encode())) for i, t in texts.items()}
    assert {r.law for r in rows} == {"bytes"} and {r.shard for r in rows} == set(range(8)) and {r.grown_shard for r in rows} == {None}
    for s in range(8):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))


def test_op4_and_op6(run, texts):
    for r in run("op4_matroska")[1]:
        raw = texts[r.doc_id].encode()
        payload = raw + b"\xff" * ((-len(raw)) % 576 if raw else 576)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
    for r in run("op6_pii_spans")[1]:
        assert r.base_sha256 == hashlib.sha256(brute_spans(texts[r.doc_id]).encode()).hexdigest()


def test_op7_round_trip(run, texts):
    for r in run("op7_sentencepiece")[1]:
        assert r.parity and r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_op8(spark, run, sf):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = run("op8_language_id")[1]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.95 * len(held)


def test_op9_finds_every_copied_item(spark, run, sf, texts):
    items = spark.read.parquet(f"{sf}/benchmark.parquet").collect()
    holds = {i for i, t in texts.items() if any(b.text in t for b in items)}
    found = {r.doc_id for r in run("op9_lsa_decontamination")[1] if r.contaminated}
    assert holds <= found and len(run("op9_lsa_decontamination")[1]) == len(texts)


def test_op10(run, texts):
    want = brute_lines(list(texts.items()))
    assert {(r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in run("op10_line_dedup")[1]} == {(i, n, g, hashlib.sha256(t.encode()).hexdigest()) for i, (n, g, t) in want.items()}


def test_op12(run, texts):
    rows = run("op12_maxent_scores")[1]
    train = Counter(t for i, x in texts.items() if not held(i) for t in tokens(x))
    n, v = sum(train.values()), len(train)
    assert len(rows) == len(texts)
    for r in rows:
        own = tokens(texts[r.doc_id])
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(r.doc_id), len(own), sum(train[t] > 0 for t in own), n)
        assert r.base_score == pytest.approx(sum(math.log10((train[t] + 1) / (n + v + 1)) for t in own), rel=1e-9)
    fresh = [r for r in rows if r.held_out]
    assert sum(r.score for r in fresh) > sum(r.base_score for r in fresh)
