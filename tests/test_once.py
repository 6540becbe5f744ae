"""What a row costs: payloads, findings and dealt-out rows are worked out once, whatever reads them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from caretrace.operators import causal as X
from caretrace.operators import normalize as N
from caretrace.operators import score as K
from caretrace.operators import trees as B
from caretrace.operators import validate as V
from caretrace.sources import resources as R


def plan(df):
    df.sparkSession.conf.set("spark.sql.debug.maxToStringFields", "10000")
    try:
        return df._jdf.queryExecution().optimizedPlan().toString().lower()
    finally:
        df.sparkSession.conf.unset("spark.sql.debug.maxToStringFields")


@pytest.fixture(scope="module")
def bundles(spark):
    entry = lambda kind, ref: '{"resource":{"resourceType":"%s","id":"x","subject":{"reference":"%s"},"code":{"text":"a"}}}' % (kind, ref)  # noqa: E731, UP031
    rows = [
        ("a", '{"resourceType":"Bundle","entry":[' + entry("Condition", "12345") + "," + entry("Encounter", "Patient/1") + ',{"resource":{}}]}'),
        ("b", '{"resourceType":"Bundle"}'),
        ("c", '{"resourceType":"Parameters","entry":[' + entry("Condition", "Patient/1") + "]}"),
        ("d", "{broken"),
        ("e", None),
        ("f", '{"resourceType":"Bundle","entry":[]}'),
        ("g", '{"resourceType":"Bundle","entry":[' + entry("Condition", "Patient/1") + "]}"),
        ("g", '{"resourceType":"Bundle","entry":[' + entry("Procedure", "Patient/1") + "]}"),
        (None, '{"resourceType":"Bundle","entry":[' + entry("Condition", "Patient/1") + "]}"),
    ]
    return spark.createDataFrame(rows, "bundle_id string, payload string").repartition(3)


def test_bundles_are_parsed_once(bundles):
    out = V.validate_bundle(bundles, require_encounter=True)
    assert plan(out).count("parsejson(") == 1
    got = sorted((r.bundle_id or "", r.n_resources, r.has_encounter, tuple(r.issues)) for r in out.collect())
    none, no_entry = "resourceType:value_error.bundle", "entry:value_error.missing"
    both = (no_entry, "entry.0.resource.encounter:value_error.missing", "entry.0.resource.encounter:value_error.missing")
    assert got == [
        ("", 0, False, (no_entry,)),
        ("a", 2, True, ("entry.0.resource.encounter:value_error.missing", "entry.0.resource.reference:value_error.fhir_reference", "entry.2.resource.:value_error.missing")),
        ("b", 0, False, (no_entry,)),
        ("c", 0, False, (none,)),
        ("d", 0, False, (none,)),
        ("e", 0, False, (none,)),
        ("f", 0, False, (no_entry,)),
        ("g", 2, False, both),
        ("g", 2, False, both),
    ]


def test_entries_are_written_once(bundles):
    out = R.explode_bundles(bundles)
    once = plan(bundles.select(F.to_json(F.try_parse_json("payload")).alias("x")))
    assert plan(out).count("parsejson(") == 1 and plan(out).count("structstojson") == once.count("structstojson")
    assert sorted((r.bundle_id or "", r.position) for r in out.collect()) == [("", 0), ("a", 0), ("a", 1), ("g", 0), ("g", 0)]


def test_codings_are_read_once_a_branch(spark):
    coding = lambda *c: '{"code":{"coding":[%s]}}' % ",".join('{"system":"%s","code":"%s"}' % x for x in c)  # noqa: E731, UP031
    rows = [(1, coding(("urn:NOC", " N1 "))), (2, coding(("http://loinc.org", "8"))), (3, "{broken"), (4, None), (5, '{"code":{}}'), (6, coding(("urn:l", "X"), ("urn:NOC", "N1")))]
    terms = spark.createDataFrame([("noc_to_loinc", "N1", "T1")], "domain string, source_code string, target_code string")
    df = spark.createDataFrame(rows, "k int, payload string")
    out = N.select_coding(df, terms, kind="Observation", keys=["k"])
    assert plan(out).count("parsejson(") == 2
    got = {r.k: (r.coding and r.coding.code, r.mapped_code) for r in out.collect()}
    assert got == {1: (" N1 ", "T1"), 2: ("8", None), 5: (None, None), 6: ("N1", "T1")}


def test_rules_read_facts(spark):
    """The code of a resource is looked up once for each of the facts, not once more in every rule."""
    df = spark.createDataFrame([('{"resourceType":"Observation","id":"a","code":[1]}',)], "payload string")
    out = V.validate_resource(df)
    assert plan(out).count("$.code.coding") == 1 and plan(out).count("$.code.text") == 1
    assert V.issue_names(F.col("issues")) is not None and [i.loc for i in out.first().issues] == ["code"]


def test_a_score_builds_its_warnings_once(spark):
    names = ["benefit", "attribution", "causal", "quality", "uncertainty", "raw_uncertainty"]
    df = spark.createDataFrame([(1.0, None, None, 1.0, 0.5, 0.7), (1.0, 1.0, None, 1.0, 0.5, 0.1)], ", ".join(f"{n} double" for n in names))
    out = K.row_score(df)
    assert plan(out).count("lambdafunction") == 1
    got = sorted((r.status, r.warnings) for r in out.collect())
    assert got == [("insufficient_evidence", ["high_uncertainty", "low_support", "missing_required_component:attribution"]), ("provisional", ["causal_unavailable_score_is_provisional"])]


def test_contract_findings_are_worked_out_once(spark):
    df = spark.createDataFrame(
        [(1, "a", {"x": 1.0}), (2, "b", {"x": 1.0, "y": 2.0}), (3, None, {"x": 1.0, "y": None})], "idx int, row_id string, features map<string,double>"
    ).withColumns(
        {"missingness_flags": F.lit(None).cast("map<string,string>"), "contract_version": F.lit("v"), "source_repo": F.lit("s"), "source_grain": F.lit("g"), "clinical_timestamp": F.lit("t"),
         "recorded_timestamp": F.lit("t"), "shadow_mode": F.lit(True), "non_individual_use": F.lit(True)}
    )
    out = K.feature_contract(df, K.FeatureContract(("x", "y"), "v", "s", "g"), index="idx")
    assert plan(out).count("array_except") == 1
    assert sorted((r.row_id, r.contract_status) for r in out.collect()) == [("a", "contract_mismatch"), ("row:3", "insufficient_evidence")]


def test_permuted_rows_are_dealt_out_once(spark):
    """The fits of a placebo read written rows of the columns they need: each row meets its permuted treatment one time."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = spark.range(3000).select(F.col("id").alias("row_id"), (F.col("id") % 7).cast("double").alias("t"), (F.col("id") % 5).cast("double").alias("w"), (F.col("id") % 11).cast("double").alias("y"))
    counted = rows.mapInArrow(count, rows.schema)
    out = X.refute_effect(counted, X.CausalSpec("t", "y", ("w",)), method="placebo_treatment", base=0.0).first()
    assert seen.value <= 3 * 3000 and abs(out.refuted_ate) < 0.1


@pytest.mark.parametrize("width", [3, 12])
def test_trees_as_tables_of_cells(width, monkeypatch):
    """Walks and attributions by cell are those of the trees, with and without a table for each tree."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, width))
    y = x[:, 0] + np.sin(x[:, 1]) * x[:, 2]
    names = tuple(f"f{i}" for i in range(width))
    model = B.TreeEnsemble(names, *B.grow(x, y, n_trees=20, rate=0.3, depth=4, l2=1.0, row_share=0.9, column_share=0.9, bins=32, seed=1))
    x[0], x[1], x[2] = np.inf, -np.inf, model.cut[0, 0]
    walker = B.Walker.of(model)
    assert np.allclose(walker.predict(x), model.predict(x), atol=1e-12) and walker.predict(x[:0]).shape == (0,)
    assert width > 3 or not len(walker.rest.value)
    shares = rng.random((20, 16, 16))
    table, expected = B.attribution_tables(model, shares / shares.sum(axis=2, keepdims=True))
    paths = B.Paths.of(model)
    made = lambda w: B.Explainer(model, table, expected, w, tuple(None if p is None else B.Explainer._parts(model, paths, table, t, B.test_results_of(model, t, p)) for t, p in enumerate(w.cells.points)))
    by_cell = made(walker).attribute(x)
    monkeypatch.setattr(B, "MOST_CELLS", 0)
    by_row = made(B.Walker.of(model)).attribute(x)
    assert np.allclose(by_cell[0], by_row[0], atol=1e-12) and np.allclose(by_cell[1], model.predict(x), atol=1e-12) and np.allclose(by_row[1], by_cell[1], atol=1e-12)


def test_a_request_against_itself_has_one_cohort(spark):
    """Rows that are their own reference are one table, so that their components are worked out and written once."""
    from caretrace.operators import scoring as S

    df = spark.createDataFrame([(1, 1.0, 2.0)], "episode_id long, a double, y double")
    chosen, reference = S._cohorts(S.Request(df), ["a", "b"], "y")
    assert chosen is reference and "b" in chosen.columns
    chosen, reference = S._cohorts(S.Request(df, episode_ids=[1]), ["a"], "y")
    assert chosen is not reference
    chosen, reference = S._cohorts(S.Request(df, reference_rows=df.limit(1)), ["a"], "y")
    assert chosen is not reference
