import random
from collections import defaultdict

from caretrace.llm.spans import LONG_WORDS, MIN_SENTENCES, MIN_WORDS, cut, passage_runs, remove_spans, repeated_spans, sentence_runs, sentences


def brute(rows):
    """Sentences to remove, by (id, text): first occurrences in order, None last."""
    first, out = {}, defaultdict(set)
    uniq = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0))
    for i, t in uniq:
        for a, b, k in sentence_runs(t or ""):
            if first.setdefault(k, (i, a)) != (i, a):
                out[i].update(range(a, b))
    return {i: sorted(s) for i, s in out.items()}


def test_sentences_and_runs():
    text = "One two three. Four!  Five\nsix seven?? ... eight"
    assert [text[a:b] for a, b, _, _ in sentences(text)] == ["One two three.", "Four!", "Five", "six seven??", "...", "eight"]
    runs = sentence_runs("a b c. d e f. g h i. j.", 2, 6)
    assert [(a, b) for a, b, _ in runs] == [(0, 2), (1, 3)]
    assert sentence_runs("") == []


def test_against_brute_force(make_docs):
    rng = random.Random(3)
    pool = [" ".join(f"w{rng.randrange(50)}" for _ in range(rng.randrange(2, 14))).capitalize() + "." for _ in range(120)]
    passage = " ".join(pool[:6])
    rows = []
    for i in range(80):
        own = [" ".join(f"u{rng.randrange(10**6)}" for _ in range(9)) + "." for _ in range(6)]
        if i % 3 == 0:
            own.insert(rng.randrange(6), passage)
        if i % 7 == 0:
            own += rng.sample(pool, 4) + own[:3]
        rows.append((i, " ".join(own)))
    docs = make_docs(rows, 5)
    marks = repeated_spans(docs)
    got = {r.doc_id: [k for x in r.sentence_runs for k in range(x.a, x.b)] for r in marks.collect()}
    assert got == brute(rows)
    left = remove_spans(docs, marks)
    assert left.columns == docs.columns
    texts = {r.doc_id: r.text for r in left.collect()}
    assert passage in texts[0] and all(passage not in texts[i] for i in range(3, 80, 3))
    assert all(texts[i] == t for i, t in rows if i not in got)


def test_odd_rows(make_docs, odd_rows):
    docs = make_docs(odd_rows)
    marks = repeated_spans(docs)
    got = {r.doc_id: [k for x in r.sentence_runs for k in range(x.a, x.b)] for r in marks.collect()}
    assert got == brute(odd_rows)
    assert remove_spans(docs, marks).count() == len(odd_rows)
    assert repeated_spans(make_docs([])).collect() == []


def test_cut():
    assert cut("A b. C d. E f.", [{"a": 1, "b": 2}]) == "A b.  E f." and cut(None, None) is None and cut("", []) == ""


def covered(rows):
    """Sentences of repeated passages by (id): every run of whole sentences that is long enough, at any place but its first."""
    first, out = {}, defaultdict(set)
    for i, t in rows:
        parts = sentences(t)
        for a in range(len(parts)):
            words = 0
            for b in range(a + 1, len(parts) + 1):
                words += parts[b - 1][3]
                if words >= (LONG_WORDS if b - a == 1 else MIN_WORDS) and (b - a == 1 or b - a >= MIN_SENTENCES):
                    if first.setdefault(tuple(p[2] for p in parts[a:b]), (i, a)) != (i, a):
                        out[i].update(range(a, b))
    return {i: sorted(s) for i, s in out.items()}


def test_every_passage_against_brute_force(make_docs):
    """Passages that end in short sentences, single long sentences, and text without spaces or ASCII stops."""
    rng = random.Random(8)
    word = lambda n, v=10**6: " ".join(f"w{rng.randrange(v)}" for _ in range(n))
    han = lambda n: "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(n))
    tail = word(12) + ". " + word(5) + ". Yes. No."
    lone = word(60) + "."
    chinese = "".join(han(14) + "。" for _ in range(4))
    thai = "".join(chr(0x0E01 + rng.randrange(46)) for _ in range(90))
    rows = [(i, f"{word(9)}. {word(9)}. {(tail, lone)[i % 2]} {word(11)}. {word(9)}.\n{han(20)}。{chinese}{han(20)}。\n{thai}\n{word(7)}.") for i in range(12)]
    rows += [(20, f"{word(40, 3)}. {word(3, 3)}."), (21, " ".join(word(rng.randrange(1, 9), 2) + "." for _ in range(60)))]
    got = {r.doc_id: [k for x in r.sentence_runs for k in range(x.a, x.b)] for r in repeated_spans(make_docs(rows)).collect()}
    assert got == covered(rows)
    gone = {r.doc_id: r.text for r in remove_spans(make_docs(rows), repeated_spans(make_docs(rows))).collect()}
    for i in range(2, 12):
        assert not any(x in gone[i] for x in (tail, lone, chinese, thai, "Yes. No."))
    assert len(passage_runs("")) == 0
