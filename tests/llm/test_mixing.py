import random
import re
from collections import defaultdict

import numpy as np
import pytest

from caretrace.llm.mixing import apply_mix, mix_sources, pivot, source_targets


def brute_targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    """Reshare by weight, again and again, until no target is above its cap."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    capped = {}
    while True:
        open_ = [s for s in names if s not in capped]
        rest = share * sum(sizes.values()) - sum(capped.values())
        t = {s: rest * w[s] / sum(w[x] for x in open_) for s in open_}
        over = [s for s in open_ if t[s] > most * sizes[s]]
        if not over:
            return {**capped, **t}
        capped.update({s: most * sizes[s] for s in over})


def test_targets(spark):
    rng = random.Random(3)
    for trial in range(4):
        sizes = {s: rng.choice([0, 3, 50, 1000, 20000]) for s in ["b", "a", "Z", "é", "zz", None, "m", ""][: 3 + trial]}
        rows = [(s, n // 2) for s, n in sizes.items()] + [(s, n - n // 2) for s, n in sizes.items()]
        got = {r.source: r.target for r in source_targets(spark.createDataFrame(rows, "source string, size long")).collect()}
        assert got == pytest.approx(brute_targets(sizes))


def test_pivot_keeps_words_and_expectation():
    rng = np.random.default_rng(1)
    size = np.sort(rng.integers(1, 400, 60))[::-1].astype(float)
    total = np.zeros(60)
    for _ in range(3000):
        out = pivot(np.full(60, 0.3), size, rng)
        assert ((out > 0) & (out < 1)).sum() <= 1
        assert abs((out * size).sum() - 0.3 * size.sum()) < 1e-6
        total += out
    assert np.abs(total / 3000 - 0.3).max() < 0.05


def test_mix(make_docs):
    rng = random.Random(5)
    rows = [(k, " ".join(["w"] * rng.randrange(0, 60)) if k % 50 else None, rng.choice(["hot", "hot", "b", "c", None])) for k in range(4000)]
    docs = make_docs(rows, 6)
    got = mix_sources(docs).collect()
    assert sorted(r.doc_id for r in got) == list(range(4000))
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    text = {k: t for k, t, _ in rows}
    for r in got:
        assert r.size == len(re.findall(r"[^\x20\x09-\x0D]+", text[r.doc_id] or "")) and 0 <= r.copies <= 2
        sizes[r.source] += r.size
        taken[r.source] += r.size * r.copies
        target[r.source] = r.target
    assert target == pytest.approx(brute_targets(sizes))
    for s in sizes:
        assert abs(taken[s] - target[s]) <= 60
    again = {r.doc_id: r.copies for r in mix_sources(make_docs(rows, 2)).collect()}
    assert again == {r.doc_id: r.copies for r in got}


def test_odd_rows(make_docs, odd_rows):
    rows = [(i, t, s) for (i, t), s in zip(odd_rows, ["a", None, "", "b"] * 9, strict=False)]
    docs = make_docs(rows)
    got = mix_sources(docs)
    assert got.count() == len(rows)
    mixed = apply_mix(docs, got)
    assert mixed.columns == docs.columns
    assert mixed.count() == sum(r.copies for r in got.collect())
    assert mix_sources(make_docs([])).collect() == []
