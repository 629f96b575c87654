"""A family of thousands of close but different vectors: the nearest are found, not those of the smallest ids."""

import numpy as np
from pyspark.sql import functions as F

from tidemill.llm import ann


def test_dense_family(spark, monkeypatch):
    """None of the family is in the sample that the model is fitted on, so its members share their codes."""
    monkeypatch.setattr(ann, "TRAIN", 400)
    by_hash = [r["id"] for r in spark.range(2500).orderBy(F.xxhash64("id"), "id").collect()]
    family = by_hash[1000:]
    rng = np.random.default_rng(5)
    points = rng.normal(size=(2500, 16)).astype(np.float32)
    points[family] = 0.5 + (1e-3 * rng.normal(size=(1500, 16))).astype(np.float32)
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "vec_id long, embedding array<float>")
    asked = sorted(family)[::60]
    got = {}
    for r in ann.search(df, F.col("vec_id").isin(asked), 10).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    exact = points.astype(np.float64)
    hits = 0
    for q in asked:
        order = np.argsort(((exact - exact[q]) ** 2).sum(axis=1), kind="stable")
        hits += len(got[q] & {int(i) for i in order[1:11]})
    assert hits / (10 * len(asked)) >= 0.97
