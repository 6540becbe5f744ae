import hashlib
import random
from collections import defaultdict

from caretrace.llm.common import LOWER_BYTES
from caretrace.llm.exact import drop_exact_duplicates, exact_duplicates


def brute(rows, keep=max):
    groups = defaultdict(list)
    for i, t in rows:
        groups[hashlib.sha256((t or "").encode().translate(LOWER_BYTES)).hexdigest()].append(i)
    out = []
    for sha, ids in groups.items():
        named = [i for i in ids if i is not None]
        best = keep(named) if named else None
        done = False
        for i in ids:
            kept = i == best and not done
            done |= kept
            out.append((i, best, len(ids), kept, sha))
    return out


def order(rows):
    return sorted(rows, key=lambda r: (r[4], r[0] is None, r[0] or 0, r[3]))


def test_odd_rows(make_docs, odd_rows):
    got = [tuple(r) for r in exact_duplicates(make_docs(odd_rows)).collect()]
    assert order(got) == order(brute(odd_rows))


def test_random_groups_and_hot_text(make_docs):
    rng = random.Random(4)
    rows = [(i, rng.choice(["Hot text", "HOT TEXT", *(f"t{k}" for k in range(60))]) if i % 3 else "hot text") for i in range(600)]
    for keep, fold in (("largest", max), ("smallest", min)):
        got = [tuple(r) for r in exact_duplicates(make_docs(rows, 7), keep).collect()]
        assert order(got) == order(brute(rows, fold))


def test_empty(make_docs):
    assert exact_duplicates(make_docs([])).collect() == []


def test_drop_keeps_one_row_of_each_text(make_docs, odd_rows):
    docs = make_docs(odd_rows)
    left = drop_exact_duplicates(docs)
    assert left.columns == docs.columns
    want = sorted(str(r[0]) for r in brute(odd_rows) if r[3])
    assert sorted(str(r.doc_id) for r in left.collect()) == want
