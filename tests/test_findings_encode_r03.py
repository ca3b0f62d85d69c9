"""What encoders ask of an executor's Python."""

import numpy as np

from chronoloom.operators import encoders as N


def test_a_task_of_the_convolutions_needs_one_python_process(spark):
    """Bias, relu and the next layer's weights are one step, the last bias none."""
    adj = spark.createDataFrame([(2000, 0, 1, 0.5), (2000, 2, 1, 0.25), (2000, 1, 2, 1.0)], "year int, src long, tgt long, weight double")
    x = np.random.default_rng(2).normal(size=(4, 3))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "node long, x array<double>")
    w = N.init(1, {"w0": (3, 5), "b0": (5,), "w1": (5, 2), "b1": (2,)})
    out = N.gcn(adj, rows, [2000], w)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 2
    a = np.zeros((4, 4))
    a[0, 1], a[2, 1], a[1, 2] = 0.5, 0.25, 1.0
    want = a @ (N.relu(a @ (x @ w["w0"]) + w["b0"]) @ w["w1"]) + w["b1"]
    got = {r["node"]: r["x"] for r in out.collect()}
    assert np.allclose([got[i] for i in range(4)], want)
