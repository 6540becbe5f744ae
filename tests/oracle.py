"""Side-by-side run of registered queries in Spark and DuckDB."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


# Results that SQL does not state, and the test that checks their values.
VALUE_TESTS = {
    "train_boosted_model": "test_boosting_learns_steps_and_products",
    "score_cohort_boosted": "test_gates_of_a_request",
    "forest_effects": "test_step_effect_is_found_with_intervals",
    "train_outcome_model": "test_outcome_model_learns",
    "dml_effects_crossfit": "test_effect_recovers_a_known_slope",
    "bootstrap_ci": "test_bootstrap_is_a_refit_of_each_replicate",
    "refute_effect": "test_effect_recovers_a_known_slope",
    "discover_dag": "test_discovery_does_not_depend_on_names",
    "learn_policy": "test_policy_follows_the_labels",
    "score_cohort": "test_cohort_scores",
    "dataset_fingerprint": "test_fingerprint",
    "rescore_candidates": "test_rescoring_keeps_the_earlier_result",
    "trial_report": "test_trial_report",
}


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return str(v)
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, (int, float)):
        f = float(v)
        return repr(f + 0.0)
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=lambda r: tuple("" if x is None else str(x) for x in r))


def compare(spark, con, key, build, sql, sf_dir):
    """(ok, message) for one key."""
    t0 = time.time()
    df = build(spark, sf_dir)
    got_cols, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    t1 = time.time()
    note = f"{len(got)} rows, {t1 - t0:.1f}s"
    if sql is None:
        return key in VALUE_TESTS, note + f", values: {VALUE_TESTS.get(key, 'no SQL and no test')}"
    cur = con.execute(sql)
    want_cols, want = rows_of([d[0] for d in cur.description], cur.fetchall())
    note += f", duck {time.time() - t1:.1f}s"
    if got_cols != want_cols:
        return False, f"columns differ: spark {got_cols} duck {want_cols}"
    if got == want:
        return True, note
    have, expected = set(got), set(want)
    only_got = [r for r in got if r not in expected]
    only_want = [r for r in want if r not in have]
    return False, f"{note}; spark {len(got)} duck {len(want)} rows\n  cols  {got_cols}\n  spark {only_got[:3]}\n  duck  {only_want[:3]}"


def main(argv):
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from caretrace.session import local_session

    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = local_session("oracle", memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    qs, sqls = entry.queries(), entry.oracle_sql()
    keys = [k for k in qs if not argv or k in argv]
    bad = []
    for k in keys:
        try:
            ok, note = compare(spark, con, k, qs[k], sqls.get(k), sf_dir)
        except Exception as e:  # report and go on
            ok, note = False, f"{e.__class__.__name__}: {str(e)[:900]}"
        if not ok:
            bad.append(k)
        print(("ok   " if ok else "FAIL ") + k + " " + note, flush=True)
    print(f"{len(keys) - len(bad)}/{len(keys)} ok; failed: {bad}")


if __name__ == "__main__":
    main(sys.argv[1:])
