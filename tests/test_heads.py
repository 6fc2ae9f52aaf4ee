"""Heads of several splits fitted together, against plain numpy."""

import numpy as np
from pyspark.sql import functions as F

from skeinwork.operators import head

SCHEMA = "id long, v array<float>, label string, a string, b string, c string"


def rows():
    rng = np.random.default_rng(4)
    out = []
    for k in range(60):
        vector = [float(np.float32(x)) for x in rng.normal(size=3) + k % 3]
        out.append((k, vector, "xyz"[k % 3], "train" if k % 5 else "test", "test" if k % 2 else "train", "test"))
    out += [out[7], (90, None, "x", "train", "train", "test"), (91, [1.0, None, 2.0], "x", "train", "train", "test")]
    out += [(92, [1.0], "x", "train", "train", "test"), (93, [1.0, float("nan"), 0.0], "y", "train", "train", "test")]
    return [*out, (94, [float("inf"), 0.0, 0.0], "y", "train", "train", "test"), (95, [5.0, 5.0, 5.0], None, "train", "train", "test")]


def test_heads_of_three_splits(spark):
    table = rows()
    df = spark.createDataFrame(table, SCHEMA).repartition(5)
    classes, weights = head.fit_heads(df, "v", "label", ["a", "b", "c"], 3, steps=4, rate=0.5)
    assert classes == ["x", "y", "z"] and not weights[2].any()
    good = [r for r in table if r[0] < 90]
    for k in range(2):
        x, y = (np.array(col) for col in zip(*[(r[1], "xyz".index(r[2])) for r in good if r[3 + k] == "train"]))
        want = np.zeros((3, 3))
        for _ in range(4):
            e = np.exp(x @ want.T)
            want -= 0.5 * (e / e.sum(1, keepdims=True) - np.eye(3)[y]).T @ x / len(x)
        assert np.allclose(weights[k], want)
    told = head.heads_predicted(df, "v", ["id", "label"], classes, weights).collect()
    assert sorted(r["id"] for r in told) == sorted(r[0] for r in table if r[0] < 90 or r[0] == 95)
    vectors = {r[0]: r[1] for r in table}
    assert all(r["preds"] == [int((np.array(vectors[r["id"]]) @ w.T).argmax()) for w in weights] for r in told)


def test_heads_of_an_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    classes, weights = head.fit_heads(df, "v", "label", ["a"], 3)
    assert classes == [] and weights.shape == (1, 0, 3)
    assert head.fit_heads(spark.createDataFrame(rows(), SCHEMA).filter(F.col("id") == 95), "v", "label", ["a"], 3)[0] == []
