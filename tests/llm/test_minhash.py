import random

import numpy as np

from caretrace.llm.components import components
from caretrace.llm.minhash import BANDS, ROWS, common_counts, drop_near_duplicates, fast_sketch, near_duplicates, shingle_ids


def brute(rows, percent=85):
    sets = [shingle_ids(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            x, y = sets[a], sets[b]
            if rows[a][0] is None or rows[b][0] is None or not len(x) or not len(y):
                continue
            k = len(np.intersect1d(x, y))
            if 100 * k >= percent * (len(x) + len(y) - k):
                parent[find(a)] = find(b)
    out = []
    for a, (i, _) in enumerate(rows):
        comp = None if i is None else min(rows[b][0] for b in range(len(rows)) if rows[b][0] is not None and find(b) == find(a))
        out.append((i, len(sets[a]), comp, comp is None or comp == i))
    return out


def key(r):
    return tuple(str(x) for x in r)


def family(rng, size, base_words=120, edits=6):
    base = [f"w{rng.randrange(900)}" for _ in range(base_words)]
    for _ in range(size):
        words = list(base)
        for _ in range(rng.randrange(edits)):
            words[rng.randrange(base_words)] = f"v{rng.randrange(10**6)}"
        yield " ".join(words)


def test_against_all_pairs(make_docs):
    rng = random.Random(1)
    texts = [t for k in range(8) for t in family(rng, 12)] + [t for t in family(rng, 300, 60, 9)] + ["single words %d" % k for k in range(5)] * 2
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    got = [tuple(r) for r in near_duplicates(make_docs(rows, 5)).collect()]
    assert sorted(map(key, got)) == sorted(map(key, brute(rows)))


def test_odd_rows(make_docs, odd_rows):
    got = [tuple(r) for r in near_duplicates(make_docs(odd_rows)).collect()]
    assert sorted(map(key, got)) == sorted(map(key, brute(odd_rows)))


def test_empty(make_docs):
    assert near_duplicates(make_docs([])).collect() == []


def test_drop(make_docs):
    rows = [(5, "a b c d e f g"), (3, "A B c d e f g"), (9, "other words are here now then"), (4, None), (None, "a b c d e f g")]
    docs = make_docs(rows)
    left = drop_near_duplicates(docs)
    assert left.columns == docs.columns
    assert sorted(str(r.doc_id) for r in left.collect()) == ["3", "4", "9", "None"]


def test_sketch_fills_every_bin_and_estimates():
    rng = np.random.default_rng(0)
    small = np.unique(rng.integers(0, 2**63, 1).astype(np.uint64))
    a = np.unique(rng.integers(0, 2**63, 1000).astype(np.uint64))
    b = np.unique(np.concatenate([a[:900], rng.integers(0, 2**63, 100).astype(np.uint64)]))
    s = fast_sketch([small, a, b])
    assert s.shape == (3, BANDS * ROWS) and not (s == np.uint64(2**64 - 1)).any()
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert abs((s[1] == s[2]).mean() - true) < 0.1
    assert (s == fast_sketch([small, a, b])).all()


def test_common_counts():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 40)).astype(np.uint64)) for _ in range(30)]
    want = [[len(np.intersect1d(x, y)) for y in sets] for x in sets]
    got = common_counts(sets)
    off = ~np.eye(30, dtype=bool)
    assert (got[off] == np.array(want)[off]).all()


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(k, k + 1) for k in range(0, 40)] + [(100, k) for k in range(101, 140)] + [(7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(41)}, **{k: 100 for k in range(100, 140)}}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_small_edge_tables_are_few_files(spark):
    """However many shuffle partitions there are, a round over few edges writes few part files."""
    settings = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        found = components(spark.createDataFrame([(i, i + 1) for i in range(300) if i % 10 != 9], "a long, b long"))
        assert {r.node: r.root for r in found.collect()} == {i: i - i % 10 for i in range(300)}
        assert len(found.inputFiles()) <= 2
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
