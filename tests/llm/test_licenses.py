import pytest

from caretrace.llm.licenses import TEMPLATES, scan_licences

FILES = [
    (1, "a/LICENSE", "Released under the MIT License."), (2, "a/x.py", "no notice\ncode"), (3, "a/b/c/deep.py", None),
    (4, "a/b/LICENSE.txt", "Licensed under the Apache License, Version 2.0.\n"), (5, "a/b/own.py", "# Licensed under CC BY-NC 4.0.\nbody " + "w " * 5000),
    (6, "z/free.py", "plain"), (7, None, ""), (8, "ab/y.py", ""), (9, "a/b/q.py", ""), (9, "a/b/q.py", ""), (None, "a/n.py", "driving licence of a person"),
]


def run(spark, files):
    df = spark.createDataFrame([(i, p, t, "c", "c") for i, p, t in files], "doc_id long, path string, text string, dir string, own string")
    return scan_licences(df)


def test_own_and_inherited(spark):
    got = {(r.doc_id, r.path): (r.licence, r.found, r.from_dir) for r in run(spark, FILES).collect()}
    assert got == {
        (1, "a/LICENSE"): ("MIT", "own", None), (2, "a/x.py"): ("MIT", "inherited", "a"), (3, "a/b/c/deep.py"): ("Apache-2.0", "inherited", "a/b"),
        (4, "a/b/LICENSE.txt"): ("Apache-2.0", "own", None), (5, "a/b/own.py"): ("CC-BY-NC-4.0", "own", None), (6, "z/free.py"): (None, "none", None),
        (7, ""): (None, "none", None), (8, "ab/y.py"): (None, "none", None), (9, "a/b/q.py"): ("Apache-2.0", "inherited", "a/b"), (None, "a/n.py"): ("MIT", "inherited", "a"),
    }
    assert run(spark, FILES).count() == len(FILES)


def test_root_licence_reaches_all(spark):
    got = run(spark, [(1, "COPYING", "GNU General Public License, version 3"), (2, "x/y/z.c", "code"), (3, "top.c", None)]).collect()
    assert {r.doc_id: (r.licence, r.from_dir) for r in got} == {1: ("GPL-3.0", None), 2: ("GPL-3.0", ""), 3: ("GPL-3.0", "")}


def test_every_template_finds_itself(spark):
    files = [(k, f"f{k}", t) for k, t in enumerate(t for ts in TEMPLATES.values() for t in ts)]
    names = [n for n, ts in TEMPLATES.items() for _ in ts]
    got = {r.doc_id: (r.licence, r.cosine) for r in run(spark, files).collect()}
    assert [got[k][0] for k in range(len(names))] == names
    assert all(c == pytest.approx(1) for _, c in got.values())


def test_empty(spark):
    assert run(spark, []).collect() == []
