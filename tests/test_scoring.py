"""Boosted model, its attribution, and whole scoring requests."""

import itertools
from math import factorial

import numpy as np
import pytest
from pyspark.sql import functions as F

from caretrace import constants as C
from caretrace.operators import model as M
from caretrace.operators import score as K
from caretrace.operators import scoring as R
from caretrace.operators import trees as B
from caretrace.session import cut_lineage

NAMES = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 4))
    return x, 2 * (x[:, 0] > 0.3) + x[:, 1] * x[:, 2] + 0.1 * rng.normal(size=1500)


def grown(data, n_trees=200, depth=4, rate=0.1, l2=1.0):
    x, y = data
    return B.TreeEnsemble(tuple(NAMES), *B.grow(x[:1000], y[:1000], n_trees=n_trees, rate=rate, depth=depth, l2=l2, row_share=0.9, column_share=0.9, bins=64, seed=1))


def test_boosting_learns_steps_and_products(data):
    x, y = data
    wrong = grown(data).predict(x[1000:]) - y[1000:]
    assert (wrong**2).mean() < 0.1 * y[1000:].var()


def test_first_split_is_the_best_of_all():
    """One full tree of depth 1 against every cut, with and without L2."""
    rng = np.random.default_rng(5)
    for l2 in (0.0, 1.0, 50.0):
        x, y = rng.integers(0, 6, size=(60, 3)).astype(float), rng.normal(size=60)
        f, cut, value, base = B.grow(x, y, n_trees=1, rate=1.0, depth=1, l2=l2, row_share=1.1, column_share=1.0, bins=64, seed=0)
        g = y.mean() - y
        worth = {}
        for k in range(3):
            for c in np.unique(x[:, k])[:-1]:
                left = x[:, k] <= c
                worth[k, c] = g[left].sum() ** 2 / (left.sum() + l2) + g[~left].sum() ** 2 / ((~left).sum() + l2)
        k, c = max(worth, key=worth.get)
        assert (f[0, 0], cut[0, 0]) == (k, c)
        left = x[:, k] <= c
        assert np.allclose(value[0], [-g[left].sum() / (left.sum() + l2), -g[~left].sum() / ((~left).sum() + l2)])


def shapley(model, background, rows):
    """Attribution by all coalitions: what the definition says."""
    n, out = background.shape[1], np.zeros(rows.shape)

    def mean(known, row):
        z = background.copy()
        z[:, list(known)] = row[list(known)]
        return model.predict(z).mean()

    for r, row in enumerate(rows):
        for i in range(n):
            for k in range(n):
                for s in itertools.combinations([j for j in range(n) if j != i], k):
                    out[r, i] += factorial(k) * factorial(n - k - 1) / factorial(n) * (mean((*s, i), row) - mean(s, row))
    return out


def frame(spark, x, **more):
    rows = [(i, *map(float, r)) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "row_id long, " + ", ".join(f"{n} double" for n in NAMES)).withColumns(more).repartition(4)


def test_attribution_is_the_shapley_value(spark, data):
    x, _ = data
    model = grown(data, n_trees=8)
    df = frame(spark, x[:40], tags=F.array(F.lit("x")), when=F.lit("2024-01-01").cast("timestamp_ntz"))
    out = B.explained(df, B.Explainer.of(model, df), replace={"a": 0.5})
    rows = sorted(out.collect(), key=lambda r: r.row_id)
    assert np.allclose([[r[f"phi_{n}"] for n in NAMES] for r in rows], shapley(model, x[:40], x[:40]), atol=1e-9)
    assert np.allclose([r.prediction for r in rows], model.predict(x[:40]))
    swapped = x[:40].copy()
    swapped[:, 0] = 0.5
    assert np.allclose([r.baseline for r in rows], model.predict(swapped))
    assert rows[0].tags == ["x"] and rows[0].when is not None


def test_packed_form_of_a_library_model(spark, data):
    x, y = data
    df = frame(spark, x[:400]).join(spark.createDataFrame([(i, float(v)) for i, v in enumerate(y[:400])], "row_id long, y double"), "row_id")
    fitted, held = M.train_outcome_model(df, features=NAMES, target="y", row_id="row_id", n_trees=6, learning_rate=0.3, depth=3)
    packed = B.TreeEnsemble.from_ml(fitted, NAMES)
    for r in B.predicted(held, packed, out="again").collect():
        assert r.again == pytest.approx(r.prediction)


def test_training_on_a_table(spark, data):
    """Missing values, absent columns, a bound on the rows, no rows; a repeated fit is the same."""
    x, y = data
    df = frame(spark, x).join(spark.createDataFrame([(i, float(v) if i % 50 else None) for i, v in enumerate(y)], "row_id long, y double"), "row_id")
    df = df.withColumn("d", F.when(F.col("row_id") % 7 != 0, F.col("d")).otherwise(float("nan")))
    args = {"features": [*NAMES, "absent"], "target": "y", "row_id": "row_id", "n_trees": 30, "rate": 0.2}
    one, two = B.boosted_model(df, **args), B.boosted_model(df.repartition(7), **args)
    assert all(np.array_equal(getattr(one, n), getattr(two, n)) for n in ("feature", "cut", "value")) and (one.feature != 4).all()
    small = B.boosted_model(df, **args, sample_rows=300)
    assert len(small.value) == 30 and not np.array_equal(small.value, one.value)
    none = B.boosted_model(df.filter(F.lit(False)), **args)
    assert none.predict(np.zeros((2, 5))).tolist() == [0.0, 0.0]
    assert B.explained(df, B.Explainer.of(none, df)).agg(F.sum("phi_a")).first()[0] == 0.0


def timed(df):
    spec = {f: "2024-01-01T00:00:00Z" for f in C.TEMPORAL_FIELDS} | {"censoring_reason": "not_censored", "outcome_status": C.STATUS_DEFENSIBLE, "temporal_spec_version": C.TEMPORAL_SPEC_VERSION}
    return df.withColumn("temporal_spec", F.create_map(*[F.lit(x) for p in spec.items() for x in p]))


@pytest.mark.parametrize("kind", ["linear", "boosted"])
def test_gates_of_a_request(spark, data, kind):
    x, y = data
    df = timed(frame(spark, x[:200]).join(spark.createDataFrame([(i, float(v)) for i, v in enumerate(y[:200])], "row_id long, y double"), "row_id").withColumns({"missing_a": F.lit(0.0), "unit_id": (F.col("row_id") % 2).cast("int"), "episode_id": F.col("row_id")}))
    model = M.fit_linear(df, NAMES, "y") if kind == "linear" else grown(data, n_trees=20)
    sound = spark.createDataFrame([(True, [])], "defensible boolean, statuses array<string>")
    args = {"model": model, "governed": ["a"], "target": "y", "drift": df.agg(*[f(c).alias(f"{c}_{n}") for c in NAMES for f, n in ((F.avg, "mean"), (F.stddev_pop, "std"))]), "q_hat": 0.5, "train_rows": 200}
    run = lambda request, artifact=sound, **more: R.score_request(request, artifact=artifact, **args, **more)

    rows = run(R.Request(df, unit_id=1)).collect()
    assert len(rows) == 100 and all(r.status == "provisional" and r.score is not None for r in rows)
    pdf = df.filter("unit_id = 1").toPandas().set_index("row_id").sort_index()
    filled = pdf[NAMES].copy()
    filled["a"] = pdf.a.median()
    said = lambda z: model.predict(z.to_numpy()) if kind == "boosted" else model.intercept + z.to_numpy() @ np.array(model.coefs)
    got = {r.row_id: r for r in rows}
    assert np.allclose([got[i].raw_benefit for i in pdf.index], pdf.y - said(filled), atol=1e-9)
    assert np.allclose([got[i].prediction for i in pdf.index], said(pdf[NAMES]), atol=1e-9)

    late = df.withColumn("temporal_spec", F.when(F.col("row_id") == 3, F.map_filter("temporal_spec", lambda k, v: k != "index_time")).otherwise(F.col("temporal_spec")))
    batch = {r.row_id: r for r in run(R.Request(late, reference_rows=df)).collect()}
    assert batch[3].status == "insufficient_temporal_spec" and batch[4].status == "temporal_leakage_blocked"
    assert batch[4].warnings == ["scoring_blocked_by_batch_temporal_failure"] and all(r.score is None and r.benefit is None for r in batch.values())
    if kind == "boosted":  # the other gates do not read the model
        return
    other = {r.row_id: r for r in run(R.Request(df, reference_rows=late)).collect()}
    assert {r.status for r in other.values()} == {"blocked_by_reference_temporal_spec"}

    bad = spark.createDataFrame([(False, ["evidence_incomplete", "model_not_defensible"])], sound.schema)
    refused = cut_lineage(run(R.Request(df), bad))
    end = R.request_outcome(refused, R.evidence_detail(bad)).first()
    assert refused.count() == 0 and (end.detail, end.rows_requested) == ("model_not_defensible", 0)
    nobody = sound.filter(F.lit(False))
    assert R.evidence_detail(sound, baseline_asked=True).first().detail == "baseline_model_not_found"
    assert R.evidence_detail(sound, baseline=nobody).first().detail == "baseline_model_not_found"
    assert R.evidence_detail(sound, baseline=bad).first().detail == "baseline_model_not_defensible"
    assert R.evidence_detail(sound, baseline=sound).first().detail is None
    fine = R.request_outcome(cut_lineage(run(R.Request(df))), R.evidence_detail(sound)).first()
    assert (fine.detail, fine.rows_scored, fine.status_counts) == (None, 200, {"provisional": 200})
    empty = cut_lineage(run(R.Request(df, unit_id=9)))
    assert R.request_outcome(empty, R.evidence_detail(sound)).first().detail == "no_rows_available_for_scoring"


def test_contract_of_outside_rows(spark):
    rows = spark.createDataFrame(
        [(k, f"r{k}", {"a": float(k % 5), "b": 1.0 + k % 3, "y": float(k)} if k != 4 else {"a": 1.0}) for k in range(12)], "idx long, row_id string, features map<string,double>"
    ).withColumns(
        {"episode_id": F.lit("e"), "window_id": F.lit(None).cast("string"), "patient_key": F.lit("p"), "unit_id": F.lit(1), "start_dt": F.lit("2024-01-01").cast("timestamp_ntz"), "end_dt": F.lit("2024-01-01").cast("timestamp_ntz"),
         "clinical_timestamp": F.lit("2024-01-01").cast("timestamp_ntz"), "recorded_timestamp": F.lit("2024-01-01").cast("timestamp_ntz"), "missingness_flags": F.lit(None).cast("map<string,string>"), "staff_shares": F.lit(None).cast("map<string,double>"),
         "staff_reliability": F.lit(None).cast("double"), "contract_version": F.lit("v1"), "source_repo": F.lit("feeds"), "source_grain": F.lit("episode"), "shadow_mode": F.lit(True), "non_individual_use": F.lit(True)}
    )
    model = M.LinearModel(("a", "b"), (1.0, 2.0), 0.0, (2.0, 2.0))
    contract = K.FeatureContract(("a", "b"), "v1", "feeds", "episode")
    sound = spark.createDataFrame([(True, [])], "defensible boolean, statuses array<string>")
    drift = spark.createDataFrame([(2.0, 1.4, 2.0, 0.8)], "a_mean double, a_std double, b_mean double, b_std double")
    ask = lambda df, ref=None: R.score_request(
        R.Request(df, "episode", reference_rows=ref, contracts=(contract,), temporal_spec=None), artifact=sound, model=model, governed=["a"], target="y", drift=drift, q_hat=1.0, train_rows=300
    )
    whole = {r.row_id: r for r in ask(rows).collect()}
    assert whole["r4"].status == "low_feature_coverage" or whole["r4"].status == "contract_mismatch"
    assert whole["r5"].status == "contract_mismatch" and "scoring_blocked_by_batch_contract_failure" in whole["r5"].warnings and whole["r5"].score is None
    fine = rows.filter("idx <> 4")
    scored = ask(fine).collect()
    assert len(scored) == 11 and all(r.score is not None and r.status == "provisional" for r in scored)
    assert {r.status for r in ask(fine, rows).collect()} == {"blocked_by_reference_contract"}
