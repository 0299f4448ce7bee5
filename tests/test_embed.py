import numpy as np

from memloom.functions import embed


def test_hashed_vectors(spark):
    v = embed.hashed(["the queue is full", "queue is full the", "", "other words"])
    assert np.allclose(v[0], v[1]) and not v[2].any() and abs(np.linalg.norm(v[3]) - 1) < 1e-6
    df = spark.createDataFrame([(1, "a b"), (2, None)], "id long, t string")
    got = {r.source_id: len(r.vector) for r in embed.vectors_of({"x": (df, "id", "t")}).collect()}
    assert got == {1: embed.DIM}
    assert [r.v for r in df.select(embed.embedded(df.t).alias("v")).collect()][1] is None
