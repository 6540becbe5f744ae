"""Hand-computed cases and invariants."""

import math
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from caretrace.functions.intervals import asof_bounds, points_in_intervals, running_counts
from caretrace.functions.quantiles import exact_quantiles_of, weighted_quantiles
from caretrace.operators import aggregate as A
from caretrace.operators import audit as L
from caretrace.operators import causal as X
from caretrace.operators import guards as G
from caretrace.operators import model as M
from caretrace.operators import report as R
from caretrace.operators import score as K
from caretrace.operators import windows as W

DAY = datetime(2026, 3, 1, 8)
H = lambda n: timedelta(hours=n)
EPISODE = "episode_id long, unit_id int, admission timestamp_ntz, discharge timestamp_ntz, ri_initial double, ri_final double"
OBS = "obs_id long, episode_id long, code_system string, code string, display string, value_num double, effective_dt timestamp_ntz"
SHIFT = "shift_id int, unit_id int, start_dt timestamp_ntz, end_dt timestamp_ntz, rn_count int, na_count int, patient_census int"


def test_roster_clipping(spark):
    episodes = spark.createDataFrame([(1, 1, DAY, DAY + H(72), 50.0, 60.0)], EPISODE)
    shifts = spark.createDataFrame(
        [
            (1, 1, DAY - H(4), DAY + H(4), 1, 0, 2),
            (2, 1, DAY + H(6), DAY + H(10), 5, 5, 1),
            (3, 1, DAY + H(18), DAY + H(30), 3, 1, 1),
            (4, 1, DAY + H(25), DAY + H(29), 20, 20, 1),
        ],
        SHIFT,
    )
    spec = W.episode_temporal_spec(episodes, as_of="2026-06-01 00:00:00")
    over = W.roster_overlap(spec, shifts, ids=["episode_id"], start="admission", end="feature_window_end")
    row = W.staffing_exposure(spec, W.census_fallback(over, episodes), ids=["episode_id"]).first()
    assert (row.nurse_hours, row.rn_hours, row.patient_hours) == (68.0, 42.0, 18.0)
    assert row.nurse_hppd == pytest.approx(68 / (18 / 24)) and row.nurse_skillmix == pytest.approx(42 / 68)


@pytest.mark.parametrize(
    "first, second, delta",
    [((19, 50, 50), (8, 0, 60), 10), ((19, 40, 50), (8, 0, 60), None), ((20, 0, 50), (8, 10, 65), 15), ((20, 0, 50), (8, 20, 65), None), ((19, 40, 50), (8, 20, 65), None)],
)
def test_nearest_boundary(spark, first, second, delta):
    start = datetime(2026, 5, 1, 20)
    obs = spark.createDataFrame(
        [
            (1, 1, "LOINC", "85556-9", "", float(first[2]), datetime(2026, 5, 1, first[0], first[1])),
            (2, 1, "LOINC", "85556-9", "", float(second[2]), datetime(2026, 5, 2, second[0], second[1])),
        ],
        OBS,
    )
    windows = spark.createDataFrame(
        [(1, 0, start, start + H(12))], "episode_id long, window_index int, outcome_window_start timestamp_ntz, outcome_window_end timestamp_ntz"
    )
    row = W.outcome_target(W.outcome_nearest(windows, W.ri_series(obs), tol_minutes=15)).first()
    assert row.delta_ri == delta
    assert row.outcome_status == ("defensible_fixed_horizon" if delta is not None else "insufficient_outcome_evidence")


def test_census_counts_match_brute_force_with_a_hot_unit(spark):
    rng = random.Random(1)
    rows = []
    for i in range(400):
        a = DAY + timedelta(minutes=rng.randrange(6000))
        d = None if i % 9 == 0 else a + timedelta(minutes=rng.randrange(-200, 3000))
        rows.append((i, 1 if i % 3 else 2, a, d, 0.0, 0.0))
    episodes = spark.createDataFrame(rows, EPISODE)
    spans = [(u, DAY + timedelta(minutes=m), DAY + timedelta(minutes=m + 240)) for u in (1, 2) for m in range(0, 6000, 173)]
    over = spark.createDataFrame(
        [(n, *s, 4.0, None) for n, s in enumerate(spans)],
        "gid int, unit_id int, overlap_start timestamp_ntz, overlap_end timestamp_ntz, overlap_hours double, patient_census int",
    )
    got = {r.gid: r.census for r in W.census_fallback(over, episodes).collect()}
    for n, (u, lo, hi) in enumerate(spans):
        want = sum(1 for r in rows if r[1] == u and r[2] <= hi and (r[3] is None or r[3] >= lo))
        assert got[n] == max(want, 1)


def test_asof_and_interval_joins_match_brute_force(spark):
    rng = random.Random(2)
    points = [(k, DAY + timedelta(minutes=rng.randrange(20000)), n) for n, k in enumerate([1] * 300 + [2] * 30)]
    anchors = [(k, n, DAY + timedelta(minutes=rng.randrange(-500, 20500))) for n, k in enumerate([1] * 200 + [2] * 50 + [3] * 5)]
    p = spark.createDataFrame(points, "k int, t timestamp_ntz, v long")
    a = spark.createDataFrame(anchors, "k int, aid int, at timestamp_ntz")
    found = asof_bounds(a, p, keys=["k"], anchor_ts="at", point_ts="t", point_cols=["v"], bucket_hours=7).collect()
    assert len(found) == len(anchors)
    for r in found:
        mine = sorted((t, v) for k, t, v in points if k == r.k)
        before, after = [x for x in mine if x[0] <= r.at], [x for x in mine if x[0] >= r.at]
        assert (None if r.prev is None else tuple(r.prev)) == (before[-1] if before else None)
        assert (None if r.next is None else tuple(r.next)) == (after[0] if after else None)
    spans = spark.createDataFrame([(1, i, DAY + H(i * 9), DAY + H(i * 9 + 30)) for i in range(30)], "k int, sid int, s timestamp_ntz, e timestamp_ntz")
    got = {(r.sid, r.v) for r in points_in_intervals(p, spans, key="k", ts="t", start="s", end="e", bucket_hours=5).collect()}
    assert got == {(i, v) for i in range(30) for k, t, v in points if k == 1 and DAY + H(i * 9) <= t < DAY + H(i * 9 + 30)}


def test_running_counts_edges(spark):
    t = lambda m: DAY + timedelta(minutes=m)
    opened = spark.createDataFrame([(1, t(10)), (1, t(60))], "u int, t timestamp_ntz")
    closed = spark.createDataFrame([(1, t(30))], "u int, t timestamp_ntz")
    q = spark.createDataFrame([(1, t(30), t(60)), (1, t(31), t(59)), (1, t(0), t(9)), (2, t(0), t(9))], "u int, lo timestamp_ntz, hi timestamp_ntz")
    got = {(r.u, r.lo, r.hi): r.n for r in running_counts(q, key="u", opened=opened, closed=closed, lower="lo", upper="hi").collect()}
    assert got == {(1, t(30), t(60)): 2, (1, t(31), t(59)): 0, (1, t(0), t(9)): 0, (2, t(0), t(9)): 0}


def test_exact_quantiles_use_the_bracket_path(spark):
    df = spark.range(60000).select(((F.col("id") * 7919) % 50021).cast("double").alias("v"))
    values = np.array([(i * 7919) % 50021 for i in range(60000)], dtype=float)
    row = exact_quantiles_of(df, [("a", "v", 0.5), ("b", "v", 0.9), ("c", "v", 0.0), ("d", "v", 1.0), ("e", "v", 0.25)]).first()
    assert [row.a, row.b, row.c, row.d, row.e] == pytest.approx(list(np.percentile(values, [50, 90, 0, 100, 25])))
    hot = df.withColumn("v", F.when(F.col("v") % 3 == 0, F.lit(10.0)).otherwise(F.col("v")))
    values[values % 3 == 0] = 10.0
    assert exact_quantiles_of(hot, [("a", "v", 0.3), ("b", "v", 0.7)]).first().asDict() == pytest.approx(
        {"a": np.percentile(values, 30), "b": np.percentile(values, 70)}
    )


def test_weighted_quantiles_match_brute_force(spark):
    rng = random.Random(3)
    rows = [(k, rng.randrange(1000) / 10, float(rng.randrange(4))) for k in [1] * 400 + [2] * 7]
    df = spark.createDataFrame(rows, "k int, v double, w double")
    out = weighted_quantiles(df, key="k", value="v", weight="w", probs=[0.1, 0.5, 0.9], names=["a", "b", "c"], cell=0.7).collect()
    for r in out:
        pairs = sorted((v, w) for k, v, w in rows if k == r.k and w > 0)
        total = sum(w for _, w in pairs)
        for q, got in ((0.1, r.a), (0.5, r.b), (0.9, r.c)):
            acc = 0.0
            for v, w in pairs:
                acc += w
                if acc >= q * total:
                    break
            assert got == v


ROW = "row_id string, patient_key string, episode_id string, unit_id int, start_dt string, score double, status string, warnings array<string>, components map<string,double>, severity_weight double, exposure_share double, staff_shares map<string,double>"


def scored(spark, rows):
    full = [(f"r{i}", f"p{i}", f"e{i}", 1, "2026-01-01T10:00:00+05:00", s, st, [], {"benefit": s}, w, x, staff) for i, (s, st, w, x, staff) in enumerate(rows)]
    return spark.createDataFrame(full, ROW)


def test_weighted_mean_and_zero_weight_defaults(spark):
    df = scored(spark, [(60.0, "complete", 1.0, 1.0, {}), (80.0, "complete", 2.0, 1.0, {})])
    assert A.weighted_score(df, group_by="unit").first().score == pytest.approx(73.333, abs=1e-3)
    zero = scored(spark, [(60.0, "complete", 0.0, 1.0, {}), (80.0, "complete", 1.0, 0.0, {})])
    assert A.weighted_score(zero, group_by="unit").first().total_weight == 2.0


def test_suppression_and_provisional_rows(spark):
    nine = scored(spark, [(60.0, "complete", 1.0, 1.0, {"a": 1.0})] * 9)
    cell = A.aggregate_scores(nine, group_by="unit").first()
    assert cell.suppressed and cell.score is None and cell.p50 is None and cell.status == "suppressed_low_support"
    soft = scored(spark, [(60.0, "provisional", 1.0, 1.0, {"a": 1.0})] * 12)
    assert A.aggregate_scores(soft, group_by="unit").first().score is None
    two = scored(spark, [(60.0, "complete", 1.0, 1.0, {"a": 0.5, "b": 0.5})] * 12)
    cell = A.aggregate_scores(two, group_by="shift", need_staff=True).first()
    assert cell.group == "unit:1|date:2026-01-01" and cell.suppression_reasons == ["n_staff_below_min_staff_count"]
    assert A.aggregate_scores(two, group_by="unit").first().score == pytest.approx(60.0, abs=1e-4)


def test_repartitioning_does_not_change_cells(spark):
    df = scored(spark, [(float(i % 37), "complete", 1.0 + i % 3, 1.0, {f"n{i % 6}": 1.0}) for i in range(60)])
    tidy = lambda rows: [{k: round(v, 9) if isinstance(v, float) else v for k, v in r.asDict().items() if k != "component_means"} for r in rows]
    a = A.aggregate_scores(df.repartition(1), group_by="date").collect()
    b = A.aggregate_scores(df.repartition(7), group_by="date").collect()
    assert tidy(a) == tidy(b)
    assert a[0].component_means["benefit"] == pytest.approx(b[0].component_means["benefit"])


def test_row_score_is_monotonic_and_blocks(spark):
    schema = "benefit double, attribution double, causal double, quality double, uncertainty double, raw_uncertainty double"
    rows = [(1.0, 0.0, 0.0, 0.0, 0.0, 0.1), (2.0, 0.0, 0.0, 0.0, 0.0, 0.1), (1.0, 0.0, 0.0, 0.0, 1.0, 0.1), (1.0, 0.0, None, 0.0, 0.0, 0.1), (None, 0.0, 0.0, 0.0, 0.0, 0.1)]
    out = K.row_score(spark.createDataFrame(rows, schema).coalesce(1)).collect()
    assert out[1].score > out[0].score > out[2].score
    assert out[3].status == "provisional" and out[3].confidence == pytest.approx(0.9 * 0.85)
    assert out[4].status == "insufficient_evidence" and out[4].score is None and out[4].warnings == ["missing_required_component:benefit"]


def test_robust_z_fallbacks(spark):
    ref = spark.createDataFrame([(5.0,)] * 8, "x double")
    row = K.robust_z(spark.createDataFrame([(7.0,)], "x double"), ref, column="x").first()
    assert row.z == 2.0 and row.z_method == "identity_fallback"
    few = spark.createDataFrame([(1.0,), (3.0,), (float("nan"),)], "x double")
    assert K.robust_z(few, few, column="x").first().z_method == "std_z_fallback"


def test_eligibility_is_two_valued(spark):
    df = spark.createDataFrame([(1, None), (2, 0.0), (3, 5.0)], "id int, x double")
    pick = lambda e: [r.id for r in df.filter(R.eligibility_mask(dict(df.dtypes), e)[0]).orderBy("id").collect()]
    assert pick({"not": {"field": "x", "op": ">", "value": 1}}) == [1, 2]
    assert pick({"field": "x", "op": "!=", "value": 5.0}) == [1, 2]
    assert pick({"field": "x", "op": "not_in", "value": [0.0]}) == [1, 3]
    assert R.eligibility_mask(dict(df.dtypes), {"field": "y"})[1] == "unknown_field:y"
    assert R.eligibility_mask(dict(df.dtypes), {"field": "x", "op": "~"})[1] == "unsupported_op:~"


def test_tree_attribution_adds_up(spark):
    df = spark.range(400).select(
        F.col("id").alias("row_id"), (F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 11).cast("double").alias("b"), (F.col("id") % 3).cast("double").alias("c")
    ).withColumn("y", F.col("a") * 2 + F.col("b") * F.col("c"))
    model, _ = M.train_outcome_model(df, features=["a", "b", "c"], target="y", row_id="row_id", n_trees=4, depth=4, learning_rate=0.3)
    from pyspark.ml.feature import VectorAssembler

    pred = {r.row_id: r.prediction for r in model.transform(VectorAssembler(inputCols=["a", "b", "c"], outputCol="_x").transform(df)).collect()}
    for r in M.tree_attribution(df, model, features=["a", "b", "c"], row_id="row_id").collect():
        assert r.phi_a + r.phi_b + r.phi_c + r.expected == pytest.approx(pred[r.row_id], abs=1e-9)


def test_effect_recovers_a_known_slope(spark):
    df = spark.range(4000).select(
        F.col("id").alias("row_id"), (F.pmod(F.xxhash64("id"), F.lit(100)) / 100.0).alias("w"), (F.pmod(F.xxhash64("id", F.lit(9)), F.lit(100)) / 100.0).alias("e")
    )
    df = df.withColumn("t", F.col("w") + F.col("e")).withColumn("y", 3 * F.col("t") * (1 + F.col("w")) + 5 * F.col("w"))
    spec = X.CausalSpec("t", "y", ("w",), ("w",), 3)
    ate = X.effect_summary(X.dml_effects(df, spec)).first().ate
    assert ate == pytest.approx(4.5, abs=0.15)
    ci = X.bootstrap_ci(df, spec, n=30).first()
    assert ci.lower < ate < ci.upper and ci.n_boot == 30
    out = X.refute_effect(df, spec, method="placebo_treatment").first()
    assert abs(out.refuted_ate) < 0.4


def test_discovery_finds_the_collider(spark):
    u = lambda s: (F.pmod(F.xxhash64("id", F.lit(s)), F.lit(10000)) / 10000.0 - 0.5)
    df = spark.range(5000).select("id", u(1).alias("a"), u(2).alias("b"), u(3).alias("n")).withColumn("c", F.col("a") + F.col("b") + 0.3 * F.col("n"))
    edges = {(r.src, r.dst, r.directed) for r in X.discover_dag(df, ["a", "b", "c"], alpha=0.01).collect()}
    assert edges == {("a", "c", True), ("b", "c", True)}


def test_discovery_does_not_depend_on_names(spark):
    """Twelve variables of a known graph: the same edges under renaming and reordering, and partial correlations by regression."""
    rng = np.random.default_rng(4)
    n, base = 4000, rng.normal(size=(4000, 12))
    x = base.copy()
    for child, parents in {3: (0, 1), 5: (3, 4), 7: (5,), 9: (7, 8), 11: (9, 2)}.items():
        x[:, child] += sum(x[:, p] for p in parents)
    names = [f"v{k:02d}" for k in range(12)]
    renamed = dict(zip(names, [f"w{k:02d}" for k in rng.permutation(12)]))
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], ", ".join(f"{c} double" for c in names)).repartition(3)
    found = lambda d, cols: {(r.src, r.dst, r.directed) for r in X.discover_dag(d, cols, alpha=0.001).collect()}
    one = found(df, names)
    two = found(df.withColumnsRenamed(renamed), [renamed[c] for c in rng.permutation(names)])
    back = {v: k for k, v in renamed.items()}
    tidy = lambda edges: {(a, b, d) if d else (*sorted((a, b)), d) for a, b, d in edges}
    assert tidy((back[a], back[b], d) for a, b, d in two) == one
    assert {("v00", "v03", True), ("v01", "v03", True), ("v03", "v05", True), ("v04", "v05", True)} <= one
    count, corr = X._correlation_matrix(df, names)
    assert count == n and np.allclose(corr, np.corrcoef(x.T))
    left = lambda y, z: y - z @ np.linalg.lstsq(z, y, rcond=None)[0]
    z = np.column_stack([np.ones(n), x[:, 5], x[:, 8]])
    assert X._partial(corr, 3, 9, np.array([[5, 8]]))[0] == pytest.approx(np.corrcoef(left(x[:, 3], z), left(x[:, 9], z))[0, 1], abs=1e-9)


def test_bootstrap_is_a_refit_of_each_replicate(spark):
    rng = np.random.default_rng(8)
    t, m = rng.normal(size=400), rng.normal(size=400)
    y = (1 + 0.5 * m) * t + rng.normal(size=400)
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(np.column_stack([t, m, y]))], "row_id long, t double, m double, y double").repartition(3)
    spec = X.CausalSpec("t", "y", ("m",), ("m",))
    got = X.bootstrap_ates(df, spec, n=300)
    assert len(got) == 300 and np.allclose(got, X.bootstrap_ates(df.repartition(7), spec, n=300))
    rows = X.residuals(df, spec).select(F.xxhash64("row_id", "t", "y").alias("h"), "_rt", "_ry", "m").toPandas()
    w = X._poisson(rows.h.to_numpy(np.int64).view(np.uint64), 0, 300, 42)
    assert abs(w.mean() - 1) < 0.02 and abs(w.var() - 1) < 0.05
    d = (rows.m - rows.m.mean()).to_numpy()
    z = np.column_stack([rows._rt, rows._rt * d])
    for k in (0, 7, 299):
        theta = np.linalg.lstsq(z * np.sqrt(w[:, [k]]), rows._ry * np.sqrt(w[:, k]), rcond=None)[0]
        assert got[k] == pytest.approx(theta[0] + theta[1] * (w[:, k] @ d) / w[:, k].sum(), rel=1e-6)
    row = X.bootstrap_ci(df, spec, n=300).first()
    assert row.n_boot == 300 and row.lower < 1 < row.upper


def test_audit_segments_and_verification(spark):
    ev = spark.range(25).select(
        F.lit("x").alias("chain"), F.col("id").alias("seq"), F.col("id").cast("string").alias("created_at"), F.lit("e").alias("event_type"), F.lit("a").alias("actor"), F.lit("c").alias("context"), F.sha2(F.col("id").cast("string"), 256).alias("payload_sha256")
    )
    args = {"chain": "chain", "seq": "seq"}
    whole = L.seal_audit_batch(ev, secret="k", **args)
    parts = None
    for k, where in enumerate(("seq < 10", "seq between 10 and 19", "seq > 19")):
        part = L.seal_audit_batch(ev.filter(where), secret="k", batch=k, tails=None if parts is None else L.chain_tails(parts, **args), **args)
        parts = part if parts is None else parts.unionByName(part)
    hashes = lambda df: [(r.seq, r.prev_hash, r.chain_hash) for r in df.orderBy("seq").collect()]
    assert hashes(parts) == hashes(whole)
    manifest = L.batch_manifest(parts, **args)
    assert [r.n_events for r in manifest.orderBy("batch").collect()] == [10, 10, 5]
    broken = lambda where: sorted((r.seq, r.reason) for r in L.verify_audit_chain(parts.filter(where), secret="k", manifest=manifest, **args).collect())
    assert broken("true") == []
    assert broken("seq <> 3") == [(4, "predecessor_missing"), (9, "batch_incomplete")]
    assert broken("seq < 24") == [(24, "batch_incomplete")]
    assert broken("batch < 2") == [(24, "batch_incomplete")]


def test_denials_against_a_walk(spark):
    rng = random.Random(3)
    rows = [("hot", rng.randrange(4 * 86_400)) for _ in range(6000)] + [(c, rng.randrange(4 * 86_400)) for c in "abc" for _ in range(30)] + [(None, 5), (None, 64), (None, 65)]
    df = spark.createDataFrame(rows, "caller string, s int").withColumn("ts", F.timestamp_seconds("s").cast("timestamp_ntz"))
    want = set()
    for c in {c for c, _ in rows}:
        last = None
        for s in sorted({s for k, s in rows if k == c}):
            if last is None or s - last >= 60:
                want.add((c, s))
                last = s
    got = L.denial_dedupe(df, keys=["caller"], ts="ts").select("caller", F.unix_seconds(F.col("ts").cast("timestamp")).alias("s")).collect()
    assert {(r.caller, r.s) for r in got} == want and len(got) == len(want)


def test_hmac_matches_the_standard_library(spark):
    import hashlib
    import hmac

    row = spark.range(1).select(L.pseudonymize_actor(F.lit("maría"), secret="pepper").alias("a")).first()
    assert row.a == "legacy_actor:" + hmac.new(b"pepper", "legacy_actor:maría".encode(), hashlib.sha256).hexdigest()


def test_guard_reports_dangerous_predictors(spark):
    df = spark.createDataFrame(
        [({"temporal_spec_version": "v", "index_time": "2026-01-01", "feature_window_start": "2026-01-01", "feature_window_end": "2026-01-02", "outcome_window_start": "2026-01-02", "outcome_window_end": "2026-01-03", "censoring_reason": "not_censored"}, 1.0)],
        "temporal_spec map<string,string>, delta_ri double",
    )
    row = G.validate_temporal(df, feature_names=["los", "age", "ri_final"]).first()
    assert row.temporal_status == "post_outcome_predictor_blocked" and row.temporal_warnings == ["post_outcome_predictor_blocked:los,ri_final"]
    assert G.validate_temporal(df).first().temporal_spec_valid


def test_e_value_and_fisher(spark):
    row = X.e_value(spark.createDataFrame([(1.0, 2.0)], "ate double, sd_y double")).first()
    rr = math.exp(0.455)
    assert row.e_value == pytest.approx(rr + math.sqrt(rr * (rr - 1)))
    assert X.fisher_p(0.0, 50) == 1.0 and X.fisher_p(0.9, 50) < 1e-9


def test_outcome_model_learns(spark):
    df = spark.range(600).select(F.col("id").alias("row_id"), (F.col("id") % 10).cast("double").alias("a"), (F.col("id") % 7).cast("double").alias("b")).withColumn("y", 3 * F.col("a") + (F.col("b") > 3).cast("double") * 10)
    model, held = M.train_outcome_model(df, features=["a", "b"], target="y", row_id="row_id", n_trees=20, depth=4, learning_rate=0.3)
    said = M.tree_attribution(df, model, features=["a", "b"], row_id="row_id").join(df, "row_id").agg(F.sqrt(F.avg((F.col("prediction") - F.col("y")) ** 2)).alias("rmse"), F.stddev_pop("y").alias("sd")).first()
    assert said.rmse < 0.1 * said.sd


def test_attribution_background_is_every_row(spark):
    df = spark.range(1000).select(F.col("id").alias("row_id"), F.col("id").cast("double").alias("a")).withColumn("y", F.col("a"))
    model, _ = M.train_outcome_model(df, features=["a"], target="y", row_id="row_id", n_trees=2, depth=3, learning_rate=0.5)
    out = M.tree_attribution(df, model, features=["a"], row_id="row_id")
    row = out.agg(F.avg("prediction").alias("p"), F.max("expected").alias("e")).first()
    assert row.e == pytest.approx(row.p, abs=1e-9)


@pytest.mark.parametrize("n", [1, 2, 19, 300, 19_999, 20_001, 60_000])
def test_quantiles_on_both_sides_of_every_size(spark, n):
    df = spark.range(n).select(F.pmod(F.xxhash64("id"), F.lit(7 * n)).cast("double").alias("v"), F.when(F.col("id") % 2 == 0, 5.0).otherwise(F.col("id").cast("double")).alias("w"))
    got = exact_quantiles_of(df, [("a", "v", 0.5), ("b", "v", 0.9), ("c", "w", 0.25), ("d", "w", 0.999)]).first()
    pdf = df.toPandas()
    want = [np.quantile(pdf.v, 0.5), np.quantile(pdf.v, 0.9), np.quantile(pdf.w, 0.25), np.quantile(pdf.w, 0.999)]
    assert [got.a, got.b, got.c, got.d] == pytest.approx(want, rel=1e-9)


def test_requests_out_of_range_are_refused(spark):
    df = spark.range(20).select(F.col("id").alias("row_id"), F.col("id").cast("double").alias("t"), F.col("id").cast("double").alias("y"), F.lit(1.0).alias("w"))
    with pytest.raises(ValueError):
        X.bootstrap_ci(df, X.CausalSpec("t", "y", ("w",), ("w",)), n=3)
    with pytest.raises(ValueError):
        X.discover_dag(df, ["t", "y"])
    many = df.select(*[(F.pmod(F.xxhash64("row_id", F.lit(k)), F.lit(1000)) / 1000.0).alias(f"v{k:02d}") for k in range(32)])
    assert X.discover_dag(many, many.columns, alpha=0.001).columns == ["src", "dst", "directed"]


def test_policy_follows_the_labels(spark):
    df = spark.range(1000).select((F.col("id") % 10).cast("double").alias("a"), F.lit(1.0).alias("b")).withColumn("policy_label", (F.col("a") > 5).cast("int")).withColumn("benefit", F.col("a") - 5)
    decided, rule = X.learn_policy(df, features=["a", "b"])
    assert decided.filter("policy_recommend_high <> policy_label").count() == 0 and "a " in rule
    assert X.policy_value(decided).first().recommended_rate == pytest.approx(0.4)


def test_cohort_scores(spark):
    from caretrace.operators.causal import CausalSpec
    from caretrace.operators.cohort_score import score_cohort

    u = lambda s: F.pmod(F.xxhash64("id", F.lit(s)), F.lit(1000)) / 1000.0
    df = spark.range(400).select("id", F.col("id").alias("row_id"), (3 + u(1)).alias("nurse_hppd"), (0.5 + u(2) / 4).alias("nurse_skillmix"), (50 + 10 * u(3)).alias("ri_initial"), F.lit(0.0).alias("missing_vs_hr_last"))
    df = df.withColumn("delta_ri", 2 * F.col("nurse_hppd") + F.col("nurse_skillmix") + 0.1 * F.col("ri_initial") + u(4))
    features = ["nurse_hppd", "nurse_skillmix", "ri_initial"]
    model = M.fit_linear(df, features, "delta_ri")
    drift = df.agg(*[f(c).alias(f"{c}_{n}") for c in features for f, n in ((F.avg, "mean"), (F.stddev_pop, "std"))])
    args = {"model": model, "governed": ["nurse_hppd"], "target": "delta_ri", "drift": drift, "q_hat": 0.5, "train_rows": 400, "causal": CausalSpec("nurse_hppd", "delta_ri", ("ri_initial",), ("ri_initial",), 2)}
    rows = score_cohort(df, df, **args).toPandas().set_index("row_id").sort_index()
    pdf = df.toPandas().set_index("row_id").sort_index()
    base = model.intercept + model.coefs[0] * pdf.nurse_hppd.median() + model.coefs[1] * pdf.nurse_skillmix + model.coefs[2] * pdf.ri_initial
    raw = pdf.delta_ri - base
    assert np.allclose(rows.raw_benefit, raw, atol=1e-6)
    mad = 1.4826 * np.median(np.abs(raw - np.median(raw)))
    assert np.corrcoef(rows.benefit, (raw - np.median(raw)) / mad)[0, 1] > 0.99
    blocked = df.withColumn("temporal_status", F.when(F.col("row_id") == 3, F.lit("temporal_leakage_blocked")))
    out = score_cohort(blocked, blocked, **args)
    assert out.filter("score is not null").count() == 0 and out.filter("status is null").count() == 0


def test_fingerprint(spark):
    df = spark.range(100).select("id", (F.col("id") % 7).cast("double").alias("x"))
    finger = lambda d: M.dataset_fingerprint(d, target="x", features=["id"], grain="window").first()
    base = finger(df)
    assert base.n_rows == 100 and finger(df.repartition(7).orderBy(F.rand(1))) == base
    assert finger(df.withColumn("x", F.when(F.col("id") == 5, 9.0).otherwise(F.col("x")))).fingerprint != base.fingerprint
    assert finger(df.unionByName(df.limit(1))).fingerprint != base.fingerprint


def test_rescoring_keeps_the_earlier_result(spark):
    from caretrace.operators import followup as U

    judged = spark.createDataFrame([(1, True), (2, True), (3, False)], "record_id long, sufficient_for_rescore boolean")
    again = spark.createDataFrame([(1, 70.0, "complete", "2024-03-01"), (2, 80.0, None, "2024-03-01"), (3, 90.0, "complete", "2024-03-01")], "record_id long, score double, status string, scored_at string")
    history = spark.createDataFrame([(2, 50.0, "enriched_followup", "2024-02-01"), (3, 55.0, "enriched_followup", "2024-02-01")], "record_id long, score double, followup_status string, scored_at string")
    got = {r.record_id: (r.followup_status, r.enriched_score) for r in U.rescore_candidates(judged, again, history).collect()}
    assert got == {1: ("enriched_followup", 70.0), 2: ("governance_blocked", 50.0), 3: ("enriched_followup", 55.0)}


def test_trial_report(spark):
    import hashlib
    import json

    df = spark.createDataFrame([(i, float(i % 5), float(i % 2), 1.0 if i % 4 == 0 else 0.0, 0.0, 1) for i in range(40)], "row_id long, nurse_hppd double, delta_ri double, missing_vs_hr_last double, missing_delta_ri double, unit_id int")
    closing = df.agg(F.avg("delta_ri").alias("ate"))
    row = R.trial_report(df, [{"description": "any", "expression": {"field": "nurse_hppd", "op": ">=", "value": 0}}], treatment="nurse_hppd", outcome="delta_ri", required=["vs_hr_last", "delta_ri"], closing=closing).first()
    body = json.loads(row.report)
    assert (row.assessed, row.eligible, row.included) == (40, 40, 30) and body["ate"] == 0.5
    assert body["reasons"][0]["excluded"] == 10 and row.report_hash == hashlib.sha256(row.report.encode()).hexdigest()


def test_contract_setting_and_rows_that_are_no_objects(spark):
    rows = spark.createDataFrame(
        [(0, "a", {"x": 1.0, "y": 2.0}, True), (1, None, None, False)], "idx long, row_id string, features map<string,double>, row_is_object boolean"
    ).withColumns({"missingness_flags": F.lit(None).cast("map<string,string>"), "contract_version": F.lit("v"), "source_repo": F.lit("r"), "source_grain": F.lit("g"), "clinical_timestamp": F.lit("t"), "recorded_timestamp": F.lit("t"), "shadow_mode": F.lit(True), "non_individual_use": F.lit(True)})
    issues = lambda limit: {r.row_id: (r.contract_status, r.contract_warnings, r.coverage) for r in K.feature_contract(rows, K.FeatureContract(("x", "y"), "v", "r", "g", None, limit), index="idx").collect()}
    gone = ("contract_mismatch", ["row_not_object"], 0.0)
    assert issues(None) == issues(0.5) == {"row:1": gone}
    for limit in ("much", float("nan")):
        assert issues(limit) == {"a": ("contract_mismatch", ["invalid_min_feature_coverage"], 1.0), "row:1": gone}
