"""A row that lacks columns is searched in a tree over the columns it has, so its ball touches few leaves."""

import numpy as np
from pyspark.sql import functions as F

from tallyforge.operators import nearest_impute as NI


def test_every_cut_prunes(spark):
    rng = np.random.default_rng(5)
    full = [[float(x) for x in v] for v in rng.uniform(size=(4096, 3))]
    rows = [([None, *v[1:]],) for v in full[:40]] + [([None, None, v[2]],) for v in full[:40]] + [(v,) for v in full]
    points = spark.createDataFrame(rows, "v array<double>").select(NI._pattern(F.col("v")).alias("pattern"), "v", F.xxhash64("v").alias("point_id"))
    nodes, roots = NI._grow_forest(points, 16)
    assert sorted(roots["111"]) == ["001", "011"] and sorted(roots["011"]) == ["001"] and roots["001"] == {}
    for both, most in (("011", 12), ("001", 3)):
        v = np.array([np.nan if bit == "0" else x for bit, x in zip(both, full[7])])
        assert 1 <= len(NI._leaves(nodes, roots["111"][both], v, 0.004)) <= most
