"""The change-feed mirror: any order, failures and replays give the table that the log says."""

import random

import pytest

from fernloom.streaming.mirror import Mirror

COLUMNS = "id long, v string"


def log(seed, n=400, keys=60):
    rng = random.Random(seed)
    rows = []
    for rev in range(1, n):
        gone = rng.random() < 0.2
        rows.append((rng.randrange(keys), None if gone else f"v{rev}", rev, gone))
    return rows


def table(rows):
    last = {}
    for k, v, rev, gone in rows:
        if k not in last or rev > last[k][1]:
            last[k] = (v, rev, gone)
    return last


def stored(mirror):
    return {r.id: (r.v, r.rev, r.deleted) for r in mirror.all_rows().collect()}


def test_any_order_and_replays(spark, tmp_path):
    rows = log(1)
    shuffled = rows[:]
    random.Random(2).shuffle(shuffled)
    mirror = Mirror(spark, str(tmp_path / "m"), "id", COLUMNS, buckets=8)
    cuts = [shuffled[i::5] for i in range(5)]
    for n, part in enumerate(cuts):
        df = spark.createDataFrame(part, mirror.schema)
        assert mirror.apply(df, n)
        before = stored(mirror)
        assert not mirror.apply(spark.createDataFrame(cuts[0], mirror.schema), n) and stored(mirror) == before
    want = table(rows)
    assert stored(mirror) == want
    assert {r.id: r.v for r in mirror.rows().collect()} == {k: v for k, (v, _, gone) in want.items() if not gone}
    assert {r.id for r in mirror.changes(350).collect()} == {k for k, (_, rev, _) in want.items() if rev > 350}
    assert mirror.manifest["rev"] == max(r[2] for r in rows)
    again = Mirror(spark, str(tmp_path / "m"), "id", COLUMNS, buckets=99)  # an existing mirror keeps its buckets
    assert stored(again) == want and again.manifest["buckets"] == 8


def test_killed_before_the_manifest_and_followed_again(spark, tmp_path, monkeypatch):
    rows = log(3)
    source = str(tmp_path / "in")
    for i in range(4):
        spark.createDataFrame(rows[i::4], Mirror(spark, str(tmp_path / "x"), "id", COLUMNS).schema).coalesce(1).write.mode("append").parquet(source)
    mirror = Mirror(spark, str(tmp_path / "m"), "id", COLUMNS, buckets=4)
    feed = lambda: spark.readStream.schema(mirror.schema).option("maxFilesPerTrigger", 1).parquet(source)
    commit, died = Mirror._commit, []

    def dies_once(self, manifest):
        if manifest["batch"] == 2 and not died:
            died.append(manifest)
            raise RuntimeError("killed between the files and the manifest")
        commit(self, manifest)

    monkeypatch.setattr(Mirror, "_commit", dies_once)
    run = mirror.follow(feed(), str(tmp_path / "cp"))
    with pytest.raises(Exception, match="killed"):
        run.awaitTermination()
    assert died and mirror.manifest["batch"] == 1
    seen = []
    run = mirror.follow(feed(), str(tmp_path / "cp"), before=lambda df, n: seen.append(n))
    run.awaitTermination()
    assert seen == [2, 3] and stored(mirror) == table(rows)


def test_odd_rows_and_empty_batches(spark, tmp_path):
    mirror = Mirror(spark, str(tmp_path / "m"), "id", COLUMNS)
    assert mirror.rows().count() == 0 and mirror.apply(spark.createDataFrame([], mirror.schema), 0)
    odd = [(None, "a", 1, False), (1, "b", None, False), (2, "c", 5, None), (2, "d", 5, None), (3, None, 1, True)]
    assert mirror.apply(spark.createDataFrame(odd, mirror.schema), 1)
    assert stored(mirror) == {2: ("d", 5, False), 3: (None, 1, True)}
