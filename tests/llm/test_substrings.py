import random
import tracemalloc

import numpy as np
import pytest

from caretrace.llm import substrings
from caretrace.llm.bwt import Strings, merged_transform, repeated_starts
from caretrace.llm.substrings import Stretches, repeated_bytes


def test_merged_transform_is_the_transform_of_all():
    """Order, common prefixes and transform against sorting; text is read back from the transform."""
    rng = random.Random(1)
    for _ in range(60):
        strings = [bytes(rng.choice(b"ab\x00\xff") for _ in range(rng.randrange(30))) for _ in range(rng.randrange(1, 9))]
        s, merged = merged_transform(strings, 40, rng.choice([1, 20, 500]))
        tail = lambda p: s.symbols[p : s.ends[p] + 1].tolist()
        rows = sorted(range(len(s.symbols)), key=lambda p: (tail(p), p))
        assert merged.rows.tolist() == rows
        assert merged.common.tolist() == [k > 0 and tail(rows[k]) == tail(rows[k - 1]) for k in range(len(rows))]
        assert sorted(merged.bwt.tolist()) == sorted(s.symbols.tolist())
        row_of = {p: k for k, p in enumerate(merged.rows.tolist())}
        for k, text in enumerate(strings):
            p, back = int(s.ends[s.starts[k]]), []
            while merged.bwt[row_of[p]]:
                back.append(int(merged.bwt[row_of[p]]) - 1)
                p -= 1
            assert bytes(reversed(back)) == text


def test_repeated_starts_against_brute_force():
    rng = random.Random(3)
    for _ in range(150):
        limit, letters = rng.choice([3, 7, 8, 10, 20, 33]), rng.choice([b"ab", b"\x00\xff", b"abc\x00"])
        base = bytes(rng.choice(letters) for _ in range(60))
        strings = [base[(a := rng.randrange(60)) : a + rng.randrange(60)] + bytes(rng.choice(letters) for _ in range(rng.randrange(20))) for _ in range(rng.randrange(1, 14))]
        seen, want = set(), set()
        for i, t in enumerate(strings):
            for o in range(len(t) - limit + 1):
                if t[o : o + limit] in seen:
                    want.add((i, o))
                seen.add(t[o : o + limit])
        assert {tuple(x) for x in repeated_starts(strings, limit, rng.choice([1, 50, 1000])).tolist()} == want


def test_equal_windows_belong_to_equal_grams():
    rng = random.Random(5)
    texts = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(400))) for _ in range(40)]
    ends = np.cumsum([len(t) for t in texts])
    data = b"".join(texts)
    want = sorted(range(len(data)))
    for size in (64, 300, 1 << 20):
        start, n, h, _ = Stretches(20, 8, size).of(data, ends)
        owner = {a + k: x for a, m, x in zip(start.tolist(), n.tolist(), h.tolist(), strict=True) for k in range(m)}
        begin = np.concatenate([[0], ends[:-1]])
        want = [p for b, e in zip(begin.tolist(), ends.tolist(), strict=True) for p in range(b, e - 19)]
        assert sorted(owner) == want
        of = {}
        for p, x in owner.items():
            assert of.setdefault(data[p : p + 20], x) == x


def brute(rows, limit):
    """(id, spans, kept) in order of (id, text), None last."""
    from xxhash import xxh3_64_intdigest

    seen, out = set(), []
    for i, t in sorted(((i, (t or "").encode()) for i, t in rows), key=lambda r: (r[0] is None, r[0] or 0, xxh3_64_intdigest(r[1]) >> 1)):
        gone = bytearray(len(t))
        for k in range(len(t) - limit + 1):
            w = t[k : k + limit]
            if w in seen:
                gone[k : k + limit] = b"\1" * limit
            seen.add(w)
        spans, k = [], 0
        while k < len(t):
            e = k
            while e < len(t) and gone[e] == gone[k]:
                e += 1
            if gone[k]:
                spans.append((k, e))
            k = e
        out.append((i, len(t), spans, bytes(b for b, g in zip(t, gone, strict=True) if not g)))
    return out


def rows_of(marks):
    return sorted(((r.doc_id, r.n_bytes, [tuple(s) for s in r.spans], bytes(r.kept)) for r in marks.collect()), key=str)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(7)
    word = lambda n: " ".join(f"w{rng.randrange(3000)}é" for _ in range(n))
    passages, rows = [word(40) for _ in range(6)], []
    for i in range(150):
        parts = [word(rng.randrange(30)) for _ in range(3)]
        if i % 3 == 0:
            p = passages[i % 6]
            parts.insert(1, p if i % 2 else p[: rng.randrange(90, 260)] + "!" + p[rng.randrange(100) :])
        rows.append((i, " ".join(parts)))
    rows += [(200 + i, rows[i][1]) for i in range(0, 40, 4)]
    rows += [(300 + i, "".join(c if rng.random() > 0.01 else "#" for c in rows[3 * i][1])) for i in range(30)]
    return [*rows, (400, "ab" * 300), (401, "x" * 99), (402, "x" * 101), (403, "y" * 100 + passages[0]), (3, passages[0]), (None, passages[1]), (None, "x" * 120)]


@pytest.mark.parametrize("most", [1, 8, 8192])
def test_against_brute_force(make_docs, texts, most):
    """Merged transforms, and windows dealt out one by one where a gram has many stretches."""
    assert rows_of(repeated_bytes(make_docs(texts, 5), most_stretches=most)) == sorted(brute(texts, 100), key=str)


def test_small_pages_and_buckets(make_docs, texts, monkeypatch):
    for name, size in (("BUCKET_BYTES", 5000), ("MERGE_BYTES", 9000)):
        monkeypatch.setattr(substrings, name, size)
    assert rows_of(repeated_bytes(make_docs(texts, 5), limit=60, gram=24, page_bytes=3000, shard_bytes=1000)) == sorted(brute(texts, 60), key=str)


def test_odd_rows(make_docs, odd_rows):
    assert rows_of(repeated_bytes(make_docs(odd_rows))) == sorted(brute(odd_rows, 100), key=str)
    assert repeated_bytes(make_docs([])).collect() == []


def test_memory_of_a_merge_and_of_a_page():
    """What a task holds at a time: 64 bytes for each of a merge's text, 32 for each of a page's."""
    rng = np.random.default_rng(9)
    base = rng.integers(97, 101, 1 << 18, dtype=np.uint8).tobytes()
    strings = [base[a : a + 130] for a in rng.integers(0, len(base) - 130, 4000).tolist()]
    page = rng.integers(97, 101, substrings.PAGE_BYTES, dtype=np.uint8).tobytes()
    tracemalloc.start()
    try:
        repeats = repeated_starts(strings, 100, substrings.SHARD_BYTES)
        assert len(repeats) and tracemalloc.get_traced_memory()[1] <= 64 * sum(map(len, strings))
        del repeats
        tracemalloc.reset_peak()
        Stretches().of(page, np.array([len(page)]))
        assert tracemalloc.get_traced_memory()[1] <= 32 * len(page)
    finally:
        tracemalloc.stop()
