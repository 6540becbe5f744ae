import hashlib
import random
import zlib

import numpy as np

from caretrace.llm.periods import periodic_runs, runs_of
from caretrace.llm.queries import looped, op12


def brute(w, least=6, times=4):
    """Every maximal stretch of each lag that is long enough and has no smaller period."""
    out = []
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            n = j + q - i
            if j > i and n >= max(least, times * q) and not any(all(w[t] == w[t + p] for t in range(i, i + n - p)) for p in range(1, q)):
                out.append((i, n, q))
            i = max(j, i + 1)
    return sorted(out)


def loops(rng, n, letters):
    w = []
    while len(w) < n:
        block = [rng.randrange(letters) for _ in range(rng.randrange(1, 9))]
        w += block * rng.randrange(1, 7) + block[: rng.randrange(len(block) + 1)] if rng.random() < 0.6 else [rng.randrange(letters)]
    return w


def test_runs_against_brute_force():
    rng = random.Random(4)
    for _ in range(1500):
        words, docs, want = [], [], []
        for d in range(rng.randrange(1, 4)):
            w = loops(rng, rng.randrange(60), rng.choice([1, 2, 2, 3, 5]))
            want += [(s + len(words), n, q) for s, n, q in brute(w)]
            words, docs = words + w, docs + [d] * len(w)
        assert runs_of(np.array(words, np.int64), np.array(docs, np.int64)) == sorted(want)
    for _ in range(500):
        w = [rng.randrange(2) for _ in range(rng.randrange(50))]
        for least, times in ((2, 3), (9, 3), (4, 5), (30, 4)):
            assert runs_of(np.array(w, np.int64), np.zeros(len(w), np.int64), least, times) == brute(w, least, times)


def expected(doc_id, text, rewrite):
    w = (text or "").encode().split()
    order = looped(doc_id, len(w)) if rewrite else None
    w = [w[k] for k in order] if order is not None else w
    runs = brute(w)
    gone = {t for s, n, q in runs for t in range(s + q, s + n)}
    return runs, b" ".join(x for k, x in enumerate(w) if k not in gone).decode()


def test_documents(make_docs, odd_rows):
    rng = random.Random(5)
    rows = [(i, " \t".join(f"w{x}" for x in loops(rng, rng.randrange(80), 3)) + "\n") for i in range(120)]
    rows += [r for r in odd_rows if len(r[1] or "") < 1000] + [(70, "a b " * 3000), (71, "é\x00 \x85\xa0 " * 9)]
    got = periodic_runs(make_docs(rows, 4)).collect()
    have = sorted((str(r.doc_id), [tuple(x) for x in r.runs], r.collapsed, r.n_words) for r in got)
    want = sorted((str(i), *expected(i, t, False), len((t or "").encode().split())) for i, t in rows)
    assert have == want
    assert periodic_runs(make_docs([])).collect() == []


def test_query_against_brute_force(spark, tmp_path, make_docs):
    rng = random.Random(6)
    rows = [(i, " ".join(f"w{rng.randrange(40)}" for _ in range(rng.randrange(120)))) for i in range(200)] + [(None, "x " * 9), (201, None)]
    make_docs(rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in op12(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows) and any(i is not None and zlib.crc32(str(i).encode()) % 10 == 0 for i in got)
    for i, t in rows:
        runs, left = expected(i, t, True)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
        r = got[i]
        assert r.n_runs == len(runs)
        assert (r.start, r.length, r.period) == (best or (None,) * 3)
        assert r.exponent_milli == (best and best[1] * 1000 // best[2])
        assert r.runs_sha256 == hashlib.sha256("".join(f"{a},{b},{c}\n" for a, b, c in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(left.encode()).hexdigest()
