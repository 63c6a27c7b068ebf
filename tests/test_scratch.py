import os

from fernloom import scratch


def test_temporary_tables_go_and_kept_ones_stay(spark):
    df = spark.range(3)
    outside = scratch.materialize(df, "outside")
    with scratch.temporary(spark):
        gone = scratch.materialize(df, "gone")
        with scratch.temporary(spark):
            inner = scratch.materialize(gone, "inner")
            kept = scratch.materialize(inner, "kept", keep=True, compression="zstd")
        assert gone.count() == 3
    assert kept.count() == outside.count() == 3
    there = [os.path.exists(x.inputFiles()[0].removeprefix("file://")) for x in (outside, kept)]
    assert there == [True, True]
    assert not any(os.path.exists(os.path.dirname(p).removeprefix("file:")) for p in [*gone.inputFiles(), *inner.inputFiles()])
