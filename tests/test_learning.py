"""The classifier against the same steps in one place, and its gradients against differences."""

import numpy as np
import pytest

from quillon.operators import learning


def test_gradient():
    r = np.random.default_rng(1)
    own = learning.Network.start((5, 4, 3, 2), 7)
    x, y = r.standard_normal((6, 5)), r.integers(0, 2, 6)
    gradient, loss, _ = own.gradient(x, y)
    for i in range(0, len(own.values), 5):
        ends = []
        for step in (1e-6, -1e-6):
            values = own.values.copy()
            values[i] += step
            ends.append(learning.Network(own.sizes, values).gradient(x, y)[1])
        assert gradient[i] == pytest.approx((ends[0] - ends[1]) / 2e-6, abs=1e-5)


def test_rounds_equal_one_place(spark):
    r = np.random.default_rng(2)
    y = r.integers(0, 3, 300)
    x = r.standard_normal((300, 8)) + 2 * np.eye(3, 8)[y]
    df = spark.createDataFrame([(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x, y))], "item long, vector array<double>, label int").repartition(7)
    split = learning.ordered_split(df, ["item"])
    assert {a.item for a in split.filter("train").collect()} == set(range(240))
    network, rounds = learning.train(split, 3, hidden=(16, 8), rounds=12, rate=0.02)
    own, adam, want = learning.Network.start((8, 16, 8, 3)), learning.Adam(len(network.values), 0.02), []
    for _ in range(12):
        gradient, loss, right = own.gradient(x[:240], y[:240])
        want.append((loss / 240, right / 240, own.gradient(x[240:], y[240:])[2] / 60))
        own = learning.Network(own.sizes, own.values - adam.step(gradient / 240))
    found = [(a.train_loss, a.train_accuracy, a.test_accuracy) for a in rounds.orderBy("round").collect()]
    assert np.allclose(found, want, atol=1e-6) and np.allclose(network.values, own.values, atol=1e-6)
    assert found[-1][0] < found[0][0] and found[-1][2] > 0.6
    answers = {a.item: (a.label, a.confidence) for a in learning.classify(df, network).collect()}
    p = own.forward(x)[-1]
    assert [answers[i][0] for i in range(300)] == p.argmax(1).tolist() and np.allclose([answers[i][1] for i in range(300)], p.max(1))


def test_slices_and_no_rows(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0], 0), (2, [0.5, -1.0], 1)], "item long, vector array<double>, label int")
    own = learning.Network.start((2, 3, 2))
    whole = own.gradient(np.array([[1.0, 2.0], [0.5, -1.0]]), np.array([0, 1]))
    gradient, loss, right, n = learning.gradient_sums(df.repartition(2), own, slice_=4)
    assert np.allclose(gradient, whole[0]) and loss == pytest.approx(whole[1]) and (right, n) == (whole[2], 2)
    assert learning.gradient_sums(df.limit(0), own)[3] == 0
    _, rounds = learning.train(df.withColumn("train", df.item < 0), 2, rounds=1)
    assert rounds.first().train_loss is None
