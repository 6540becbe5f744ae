import math
import random

import numpy as np
import pytest

from caretrace.llm import topk
from caretrace.llm.topk import top_k


def brute(rows, k=5, every=50):
    good = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, q in {(i, tuple(v)) for i, v in good if i % every == 0}:
        found = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), j) for j, v in good if j != i and len(v) == len(q))[:k]
        out += [(i, r, j, -s) for r, (s, j) in enumerate(found, 1)]
    return sorted(out)


def run(spark, rows, **kw):
    df = spark.createDataFrame([(i, v, "c", "c", 1) for i, v in rows], "vec_id long, embedding array<float>, v string, key string, score int")
    return sorted(tuple(r) for r in top_k(df, **kw).collect())


@pytest.mark.parametrize("blocks", [(1024, 2048), (3, 40)])
def test_against_brute_force(spark, monkeypatch, blocks):
    monkeypatch.setattr(topk, "QUERY_BLOCK", blocks[0])
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", blocks[1])
    rng = np.random.default_rng(2)
    rows = [(k, rng.normal(size=24).tolist()) for k in range(300)]
    rows += [(k, rows[0][1]) for k in range(300, 360)]  # one very common vector
    assert run(spark, rows) == brute(rows)
    skewed = [(k, (rng.normal(size=20) ** 3 + (k % 7)).tolist()) for k in range(200)]
    assert run(spark, skewed) == brute(skewed)


def test_odd_vectors(spark):
    rows = [(0, [0.5, -0.25]), (50, None), (100, [1.0, None]), (150, [float("nan"), 1.0]), (200, [float("inf"), 0.0]), (None, [1.0, 1.0]), (1, [0.1, 0.1]), (2, [0.1, 0.1]), (250, []), (251, []), (300, [1.0, 2.0, 3.0])]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []


def test_repeated_rows(spark):
    rng = random.Random(1)
    rows = [(k, [rng.random(), rng.random()]) for k in range(5)] + [(9, [3.0, 3.0])] * 7 + [(0, [1.0, 1.0])] * 3
    assert run(spark, rows) == brute(rows)
