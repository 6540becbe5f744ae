"""The stages one by one against brute force, the registered queries on the smallest tables."""

import os
import sys
from collections import Counter, defaultdict

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import corpus_pipeline  # noqa: E402
from caretrace.llm.common import LOWER_BYTES  # noqa: E402
from caretrace.llm.minhash import shingle_ids  # noqa: E402
from caretrace.llm.queries import ORACLES, QUERIES  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if k < 4:
            assert docs.columns == columns
        seen.append(docs)
    quality, exact, near, mixed, encoded = ([r.asDict() for r in d.collect()] for d in seen)
    best = defaultdict(int)
    for r in quality:
        k = (r["text"] or "").encode().translate(LOWER_BYTES)
        best[k] = max(best[k], r["doc_id"])
    assert sorted(r["doc_id"] for r in exact) == sorted(best.values())
    sets = {r["doc_id"]: set(shingle_ids(r["text"]).tolist()) for r in exact}
    group = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if a < b and group[a] != group[b] and sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                    low, changed = min(group[a], group[b]), True
                    group = {i: low if g in (group[a], group[b]) else g for i, g in group.items()}
    assert sorted(r["doc_id"] for r in near) == sorted({g for g in group.values()})
    copies = Counter(r["doc_id"] for r in mixed)
    assert set(copies) <= {r["doc_id"] for r in near} and max(copies.values()) <= 2
    words = {r["doc_id"]: len((r["text"] or "").split()) for r in near}
    assert sum(words[i] * n for i, n in copies.items()) == pytest.approx(1.5 * sum(words.values()), rel=0.05)
    assert Counter(r["doc_id"] for r in encoded) == copies and all(r["ids"][-1] == 2 for r in encoded)
    text = {r["doc_id"]: (r["text"] or "").encode() for r in near}
    for r in encoded:  # each piece has its span in the bytes of the text, and the end id stands at the end
        assert len(r["begins"]) == len(r["ends"]) == len(r["ids"]) and r["ends"][-1] <= len(text[r["doc_id"]])
        assert all(x <= y for x, y in zip(r["begins"], r["ends"], strict=True)) and list(r["begins"]) == sorted(r["begins"])


def test_run_is_the_stages(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_one_query_per_operator():
    assert [int(q.split("_")[0][2:]) for q in sorted(QUERIES, key=lambda q: int(q.split("_")[0][2:]))] == list(range(1, 14))
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize(("name", "stage"), corpus_pipeline.STAGES)
def test_stages_on_odd_rows(spark, make_docs, odd_rows, name, stage):
    """Nulls, empty and long texts, ties, repeated rows, clashing columns, an empty table: a defined result, no crash."""
    docs = make_docs(odd_rows)
    out = stage(spark, docs, SF)
    rows = out.collect()
    if name != "encode":
        assert out.columns == docs.columns
        ids = {r.doc_id for r in rows}
        assert ids <= {i for i, _ in odd_rows}
        assert {8, 9} & ids if name != "quality" else True
    else:
        assert len(rows) == len(odd_rows) and all(r.n_tokens >= 1 for r in rows)
    if name in ("exact_dedup", "near_dedup"):
        assert len({1, 2} & {r.doc_id for r in rows}) == 1
    nothing = stage(spark, make_docs([]), SF)
    assert nothing.collect() == [] and nothing.columns == out.columns
