import random
import zlib

import numpy as np

from caretrace.llm.quality import FEATURES, fit, keep_quality, score_quality, shallow_pair_tree, shallow_tree, text_features, train


def test_features_are_finite():
    for t in [None, "", " ", "a", "x" * 100000, "é日😀\n\n!!", "the the the the"]:
        assert len(text_features(t)) == len(FEATURES) and np.isfinite(text_features(t)).all()


def test_trees():
    g = np.array([1.0, 1, 1, -1, -1, 2, 2])
    assert np.sign(shallow_tree(g, np.ones(7))).tolist() == [1, 1, 1, -1, -1, 1, 1]
    table = np.ones((4, 4))
    table[:2, :2] = table[2:, 2:] = -1
    gain, values = shallow_pair_tree(table, np.ones((4, 4)))
    assert gain > 0 and (np.sign(values) == table).all()


def test_fit_learns_shape_and_interaction():
    rng = np.random.default_rng(0)
    x = rng.uniform(-1, 1, (4000, 4))
    y = ((np.abs(x[:, 0]) > 0.5) | (x[:, 1] * x[:, 2] > 0)).astype(float)
    model = fit(x[:3000], y[:3000])
    assert ((model.score(x[3000:]) > 0.5) == y[3000:]).mean() > 0.85
    assert (1, 2) in model.pairs


def test_constant_models():
    none = fit(np.zeros((0, 3)), np.zeros(0))
    assert none.score(np.zeros((2, 3))).tolist() == [0.5, 0.5]
    assert fit(np.zeros((8, 3)), np.ones(8)).score(np.zeros((1, 3)))[0] > 0.85


def _corpus():
    rng = random.Random(0)
    rows, labels = [], []
    for k in range(400):
        words = [rng.choice(["some", "plain", "words", "that", "read", "well", "and", "on"]) for _ in range(rng.randrange(20, 90))]
        bad = k % 4 == 0
        rows.append((k, " | ".join(words) if bad else " ".join(words).capitalize() + "."))
        labels.append((k, 0 if bad else 1, 0, "clash"))
    return rows, labels


def test_held_out_rows_never_train(spark, make_docs):
    rows, labels = _corpus()
    flipped = [(i, 1 - q if zlib.crc32(str(i).encode()) % 5 == 0 else q, t, c) for i, q, t, c in labels]
    schema = "doc_id long, quality int, toxic int, text string"
    a, b = (train(make_docs(rows), spark.createDataFrame(x, schema)) for x in (labels, flipped))
    assert (a.tables == b.tables).all() and a.base == b.base


def test_accuracy_on_held_out_rows_and_keep(spark, make_docs, odd_rows):
    rows, labels = _corpus()
    table = spark.createDataFrame([*labels, (None, 1, 0, ""), (5, None, 0, "")], "doc_id long, quality int, toxic int, text string")
    docs = make_docs(rows)
    score = {r.doc_id: r.score for r in score_quality(docs, train(docs, table)).collect()}
    held = [i for i in score if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(score[i] >= 0.3) == (i % 4 != 0) for i in held]) > 0.97
    left = keep_quality(docs, table)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {i for i in score if score[i] >= 0.3}
    odd = score_quality(make_docs(odd_rows), train(docs, table)).collect()
    assert len(odd) == len(odd_rows) and all(0 <= r.score <= 1 for r in odd)
    assert score_quality(make_docs([]), train(make_docs([]), table)).collect() == []
