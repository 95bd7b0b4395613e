"""The exchange clustering against full recomputation."""

import numpy as np
import pytest

from threadloom.llm import brown
from threadloom.llm.common import texts_in_small_batches


def test_best_classes_against_recomputation():
    rng = np.random.default_rng(1)
    for _ in range(10):
        units, classes = 20, 5
        pairs = rng.integers(0, 6, (units, units)) * (rng.random((units, units)) < 0.4)
        of = rng.integers(0, classes, units)
        by = np.eye(classes)[of]
        table, after, before = by.T @ pairs @ by, pairs @ by, pairs.T @ by
        want = []
        for u in range(units):
            t = table.copy()
            t[of[u]] -= after[u]
            t[:, of[u]] -= before[u]
            t = np.maximum(t, 0) + 0.5
            scores = [after[u] @ np.log(t[c]) + before[u] @ np.log(t[:, c]) - after[u].sum() * np.log(t[c].sum()) - before[u].sum() * np.log(t[:, c].sum()) for c in range(classes)]
            want.append(int(np.argmax(scores)))
        assert brown.best_classes(table, of, after, before).tolist() == want


def test_objective_of_a_table():
    t = np.array([[3.0, 1.0], [0.0, 2.0]])
    s = t + 0.5
    want = sum(s[u, v] * np.log(s[u, v] / s[u].sum() / s[:, v].sum()) for u in range(2) for v in range(2))
    assert brown.objective(t) == pytest.approx(want)


@pytest.mark.parametrize("gain", [0.0, 0.001])
def test_objective_never_falls(docs, gain):
    train = texts_in_small_batches(docs).select("text")
    counts = brown.word_counts(train)
    from pyspark.sql import functions as F

    frequent = counts.filter(F.col("w") != F.lit(b"")).select(F.xxhash64("w").alias("h"), "c").toPandas()
    h = frequent.sort_values(["c", "h"], ascending=[False, True])["h"].to_numpy()[:60]
    words = np.concatenate((brown.hashes([b""]), h))
    near = brown.neighbours(train, words, []).cache()
    of, table, told = brown.exchange(near, len(words) + 1, 6, gain=gain)
    assert told == sorted(told) and told[-1] > told[0] and len(told) > 3
    assert np.array_equal(table, brown.class_bigrams(near, of, 6)) and brown.objective(table) == pytest.approx(told[-1])
    assert len(told) < brown.ROUNDS + 1 or gain == 0
