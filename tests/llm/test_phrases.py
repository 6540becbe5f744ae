import random
import re
from collections import Counter

import pytest

from caretrace.llm import phrases
from caretrace.llm.phrases import collocations, frequent_phrases


def counted(rows, most=3):
    f, n = Counter(), Counter()
    for lang, text in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for size in range(1, most + 1):
                for i in range(len(w) - size + 1):
                    f[lang or "und", tuple(w[i : i + size])] += 1
    return f, n


def brute(rows, least=10, top=2000, cover=50, most=3):
    f, n = counted(rows, most)
    frequent = {p: a for p, a in f.items() if a >= least and len(p[1]) > 1}
    out = []
    for (lang, w), a in frequent.items():
        inside = [b for (g, v), b in frequent.items() if g == lang and len(v) > len(w) and any(v[i : i + len(w)] == w for i in range(len(v)))]
        if any(100 * b >= cover * a for b in inside):
            continue
        score, _, l, r = min((10**6 * a * a // (f[lang, w[:k]] * f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
        out.append((lang, -score, -a, " ".join(w).encode(), l, r))
    ranks, result = Counter(), []
    for lang, score, a, w, l, r in sorted(out):
        ranks[lang] += 1
        if ranks[lang] <= top:
            result.append((lang, ranks[lang], w.decode(), -a, l, r, n[lang], -score))
    return result


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    common = ["alpha beta gamma", "Delta\tepsilon", "zeta eta theta iota", "É é, z", "x\x85y \xa0 q"]
    out = []
    for i in range(150):
        words = [rng.choice(common) if rng.random() < 0.3 else f"w{int(rng.paretovariate(0.7)) % 90}" for _ in range(rng.randrange(1, 60))]
        out.append((i, "".join(w + rng.choice([" ", " ", "  ", "\t", ", ", ". ", "\n", "! "]) for w in words), rng.choice(["en", "de", None])))
    return [*out, (3, None, "en"), (None, "", "en"), (None, "Delta epsilon " * 2000, "fr"), (4, "one two", "xx"), (5, " \t.", "empty")]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash", 1) for r in rows], "doc_id long, text string, lang string, phrase string, size string, f int").repartition(4)


def test_against_brute_force(spark, rows):
    want = brute([(lang, t) for _, t, lang in rows])
    got = sorted(tuple(r) for r in collocations(frame(spark, rows)).collect())
    assert len(want) > 50 and got == sorted(want)
    want = brute([(lang, t) for _, t, lang in rows], least=4, top=5, cover=80, most=4)
    assert sorted(tuple(r) for r in collocations(frame(spark, rows), min_count=4, top=5, cover_percent=80, most=4).collect()) == sorted(want)


@pytest.mark.parametrize(("rate", "bits"), [(0.0, 1 << 12), (0.02, 1 << 20), (1.0, 1 << 20), (0.5, 64)])
def test_sample_and_table_do_not_change_counts(spark, rows, rate, bits):
    """No sample at all, border failures, all proposed, a full table."""
    f, n = counted([(lang, t) for _, t, lang in rows])
    want = {(lang, " ".join(w)): a for (lang, w), a in f.items() if a >= 10} | {(lang, ""): a for lang, a in n.items() if a}
    got = frequent_phrases(frame(spark, rows), rate=rate, bits=bits).collect()
    assert {(bytes(r.lang).decode(), bytes(r.phrase).decode()): r.f for r in got} == want and len(got) == len(want)


def test_flushes_and_empty(spark, rows, monkeypatch):
    monkeypatch.setattr(phrases, "HELD_BYTES", 500)
    assert collocations(frame(spark, rows[:0])).collect() == []
    assert sorted(tuple(r) for r in collocations(frame(spark, rows)).collect()) == sorted(brute([(lang, t) for _, t, lang in rows]))


def test_products_beyond_64_bits(spark, monkeypatch):
    big = 10**14
    table = spark.createDataFrame([(b"en", 0, b"", 10**15), (b"en", 1, b"a", 3 * big), (b"en", 1, b"b", 2 * big + 1), (b"en", 2, b"a b", big)], "lang binary, size int, phrase binary, f long")
    monkeypatch.setattr(phrases, "frequent_phrases", lambda *a, **k: table)
    got = collocations(frame(spark, [(1, "x", "en")])).collect()
    assert [(r.score, r.a, r.l, r.r, r.n) for r in got] == [(10**6 * big * big // (3 * big * (2 * big + 1)), big, 3 * big, 2 * big + 1, 10**15)]
