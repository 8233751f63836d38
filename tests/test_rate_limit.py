"""The exact rate limit against the queue of every user, with bursts that cross Arrow batches, and ties."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest

from tallyforge.operators.usage import rate_limit_exact


def expected(rows, limit, window):
    queues, out = {}, {}
    for user, event, ts in sorted(rows, key=lambda r: (r[2], r[1])):
        queue = [t for t in queues.get(user, []) if (ts - t).total_seconds() <= window]
        out[event] = len(queue) < limit
        queues[user] = queue + [ts] * out[event]
    return out


@pytest.mark.parametrize("limit, window, batch", [(3, 60, 7), (1, 5, 2), (5, 600, 1000), (0, 60, 4)])
def test_equals_the_queue(spark, limit, window, batch):
    rng = np.random.default_rng(limit + window)
    start = dt.datetime(2024, 1, 1)
    rows = [(int(rng.integers(0, 4)), k, start + dt.timedelta(seconds=int(rng.integers(0, 4000)))) for k in range(400)]
    rows += [(9, 1000 + k, start + dt.timedelta(seconds=k // 3)) for k in range(200)]
    earlier = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        found = rate_limit_exact(spark.createDataFrame(rows, "user_id long, event_id long, ts timestamp"), limit, window).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", earlier)
    assert len(found) == len(rows) and {r.event_id: r.accepted for r in found} == expected(rows, limit, window)
