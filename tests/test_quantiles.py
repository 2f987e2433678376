import random

import numpy as np
import pytest

from tallyrift.operators import ranking
from tallyrift.operators.quantiles import weighted_quantiles


@pytest.mark.parametrize("limit", [0, 100_000])
def test_quantiles_equal_those_of_the_values_written_out(spark, monkeypatch, limit):
    monkeypatch.setattr(ranking, "SINGLE_TASK_ROWS", limit)
    draw = random.Random(1)
    rows = [(draw.choice(["a", "b", None]), draw.choice([0.5, 1.0, 2.0, 7.0, draw.gauss(0, 1)]), draw.randint(1, 900)) for _ in range(500)]
    rows += [("one", 3.0, 1), ("same", 2.0, 5), ("same", 2.0, 5), ("a", None, 4), ("a", 9.0, 0), ("none", None, 1)]
    frame = spark.createDataFrame(rows, "k string, x double, n bigint").repartition(5)
    shares = (0.0, 0.25, 0.5, 0.9, 1.0)
    got = {r.k: r.quantiles for r in weighted_quantiles(frame, ["k"], "x", shares, "n").collect()}
    known = {k for k, x, n in rows if x is not None}
    assert set(got) == known
    for k in known:
        values = np.concatenate([np.full(n, x) for kk, x, n in rows if kk == k and x is not None])
        assert got[k] == pytest.approx(np.quantile(values, shares).tolist(), abs=1e-12)
    once = {r.k: r.quantiles for r in weighted_quantiles(frame, ["k"], "x", (0.5,)).collect()}
    assert once["b"] == pytest.approx([np.median([x for k, x, _ in rows if k == "b"])])


def test_no_rows(spark):
    assert weighted_quantiles(spark.createDataFrame([], "k string, x double"), ["k"], "x", (0.5,)).count() == 0
