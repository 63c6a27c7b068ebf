import hashlib

import numpy as np
from pyspark.sql import functions as F

from fernloom.operators.plugins import embed


def test_words_beyond_the_cache_keep_their_dimension(spark):
    texts = [" ".join(f"w{i}" for i in range(100_000)), "late words after a full cache", "w7 late"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").coalesce(1)
    got = {r.id: r.v for r in df.select("id", embed(F.col("text")).alias("v")).collect()}
    for i in (1, 2):
        want = np.zeros(64, np.float32)
        for w in texts[i].split():
            want[int.from_bytes(hashlib.blake2b(w.encode(), digest_size=4).digest(), "big") % 64] += 1
        assert np.allclose(got[i], want / np.linalg.norm(want))
