"""Registered queries of the temporal guardrails."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caretrace import constants as C
from caretrace.operators import guards as G
from caretrace.plans.adapter import Tables
from caretrace.plans.base import emit, query

GUARD_SQL = """
SELECT o_orderkey AS row_id,
 CASE k WHEN 0 THEN 'insufficient_temporal_spec' WHEN 1 THEN 'insufficient_temporal_spec' WHEN 2 THEN 'temporal_leakage_blocked' WHEN 3 THEN 'temporal_leakage_blocked'
  WHEN 4 THEN 'temporal_leakage_blocked' WHEN 5 THEN 'temporal_leakage_blocked' WHEN 6 THEN 'legacy_outcome_not_defensible' WHEN 7 THEN 'insufficient_outcome_evidence'
  WHEN 8 THEN 'insufficient_outcome_evidence' WHEN 9 THEN 'temporal_leakage_blocked' WHEN 10 THEN 'temporal_leakage_blocked' END AS temporal_status,
 CASE k WHEN 0 THEN 'insufficient_temporal_spec|missing_temporal_fields:censoring_reason,index_time' WHEN 1 THEN 'insufficient_temporal_spec'
  WHEN 2 THEN 'feature_window_start_after_feature_window_end' WHEN 3 THEN 'outcome_window_start_after_outcome_window_end'
  WHEN 4 THEN 'feature_window_end_after_outcome_window_start' WHEN 5 THEN 'index_time_after_outcome_window_start' WHEN 6 THEN 'legacy_outcome_not_defensible'
  WHEN 7 THEN 'discharged_before_outcome_window_end' WHEN 8 THEN 'missing_outcome_target' WHEN 9 THEN 'invalid_feature_timestamp:hr'
  WHEN 10 THEN 'future_feature_timestamps_blocked:hr,sbp' ELSE '' END AS temporal_warnings, k > 10 AS temporal_spec_valid, k IN (2, 3, 4, 5, 9, 10) AS flag_leakage_blocked
FROM (SELECT *, o_orderkey % 16 AS k FROM orders)"""


def checked(t: Tables) -> DataFrame:
    return G.validate_temporal(t.guarded, stamps="feature_timestamps", feature_names=["delta_ri", "ri_initial"])


@query("validate_temporal", GUARD_SQL)
def _(t: Tables) -> DataFrame:
    return emit(checked(t).select("row_id", "temporal_status", "temporal_warnings", "temporal_spec_valid", "flag_leakage_blocked"))


@query(
    "feature_time_leakage",
    """SELECT o_orderkey AS row_id, CASE WHEN o_orderkey % 16 = 9 THEN 'hr' ELSE '' END AS invalid_feature_timestamps,
    CASE WHEN o_orderkey % 16 = 10 THEN 'hr|sbp' ELSE '' END AS leaked_features, o_orderkey % 16 IN (9, 10) AS leakage_blocked FROM orders""",
)
def _(t: Tables) -> DataFrame:
    out = G.feature_time_leakage(t.guarded)
    return emit(out.select("row_id", "invalid_feature_timestamps", "leaked_features", "leakage_blocked"))


@query(
    "temporal_batch_gate",
    f"""WITH g AS ({GUARD_SQL}), u AS (SELECT DISTINCT unnest(string_split(temporal_warnings, '|')) AS w FROM g WHERE temporal_status IS NOT NULL)
    SELECT count(temporal_status) > 0 AS blocked, count(temporal_status) AS blocked_rows, arg_min(temporal_status, row_id) FILTER (WHERE temporal_status IS NOT NULL) AS status,
    (SELECT string_agg(w, '|' ORDER BY w) FROM u) AS warnings FROM g""",
)
def _(t: Tables) -> DataFrame:
    return emit(G.temporal_batch_gate(checked(t), order="row_id"))


DOMAIN_BITS = list(enumerate(C.CASE_MIX_DOMAINS))


@query(
    "case_mix_check",
    "WITH x AS (SELECT p_partkey, list_filter(["
    + ", ".join(f"CASE WHEN p_partkey // {2**i} % 2 = 0 AND NOT (p_partkey % 5 = 0 AND {i} < 2) THEN '{d}' END" for i, d in DOMAIN_BITS)
    + """], lambda x: x IS NOT NULL) AS missing FROM part)
    SELECT p_partkey, array_to_string(missing, '|') AS missing_domains, len(missing) = 0 AS case_mix_sufficient,
    CASE WHEN len(missing) > 0 THEN 'case_mix_insufficient|missing_case_mix_domains:' || array_to_string(missing, ',') ELSE '' END AS case_mix_warnings FROM x""",
)
def _(t: Tables) -> DataFrame:
    part = t.raw("part")
    entries = [
        F.when(F.floor(F.col("p_partkey") / 2**i) % 2 == 1, F.lit(f'"{d}":["c"]')).otherwise(F.lit(f'"{d}":[]')) for i, d in DOMAIN_BITS
    ]
    listed = F.when(F.col("p_partkey") % 5 == 0, F.lit(f',"variables":["{C.CASE_MIX_DOMAINS[0]}","{C.CASE_MIX_DOMAINS[1]}"]')).otherwise(F.lit(""))
    spec = F.concat(F.lit('{"domains":{'), F.concat_ws(",", *entries), F.lit("}"), listed, F.lit("}"))
    return emit(G.case_mix_check(part.select("p_partkey", spec.alias("case_mix_spec"))).drop("case_mix_spec"))


ORDER_SQL = """
WITH x AS (SELECT p_partkey, p_partkey % 12 AS k FROM part)
SELECT p_partkey, CASE k
 WHEN 0 THEN 'insufficient_temporal_spec|treatment_missing|treatment_outcome_temporal_order_not_proven' WHEN 1 THEN '' WHEN 2 THEN ''
 WHEN 3 THEN 'insufficient_temporal_spec|target_trial_temporal_order_not_demonstrated|treatment_outcome_temporal_order_not_proven'
 WHEN 4 THEN 'insufficient_temporal_spec|invalid_causal_temporal_spec|treatment_outcome_temporal_order_not_proven'
 WHEN 5 THEN 'feature_window_start_after_feature_window_end|insufficient_temporal_spec|invalid_causal_temporal_spec|treatment_outcome_temporal_order_not_proven|treatment_window_start_after_treatment_window_end'
 WHEN 6 THEN 'feature_window_end_after_treatment_window_start|insufficient_temporal_spec|invalid_causal_temporal_spec|post_treatment_features_in_baseline_window|treatment_outcome_temporal_order_not_proven'
 WHEN 7 THEN 'confounder_post_treatment:age' WHEN 8 THEN 'confounder_not_pre_treatment_in_dag:age|confounder_post_treatment:age'
 WHEN 9 THEN 'confounder_not_pre_treatment_in_dag:sev' WHEN 10 THEN 'insufficient_temporal_spec|invalid_causal_temporal_spec|treatment_outcome_temporal_order_not_proven' ELSE '' END AS causal_warnings,
 CASE WHEN k IN (1, 2, 11) THEN NULL ELSE 'temporal_leakage_blocked' END AS causal_status, k = 6 AS post_treatment_feature_leakage FROM x"""


@query("causal_temporal_order", ORDER_SQL)
def _(t: Tables) -> DataFrame:
    # Twelve kinds of specification, one per part number modulo twelve.
    k = F.col("p_partkey") % 12
    iso = lambda h: F.lit(f"2024-01-0{1 + h // 24}T{h % 24:02d}:00:00Z")

    def spec(fs: int, fe: int, os_: int, oe: int, **more: int):
        names = {"feature_window_start": fs, "feature_window_end": fe, "outcome_window_start": os_, "outcome_window_end": oe, **more}
        return F.create_map(*[c for n, h in names.items() for c in (F.lit(n), iso(h))])

    good = spec(0, 12, 12, 24)
    none = F.lit(None).cast("map<string,string>")
    temporal = (
        F.when(k.isin(2, 7, 8, 9, 11), good)
        .when(k == 4, F.map_filter(good, lambda a, b: a != "outcome_window_end"))
        .when(k == 5, spec(13, 12, 14, 24))
        .when(k == 6, spec(0, 12, 14, 24, treatment_time=10))
        .when(k == 10, spec(0, 12, 13, 24, treatment_window_start=12, treatment_window_end=15))
        .otherwise(none)
    )
    edges = (
        F.when(k == 8, F.array(F.array(F.lit("hppd"), F.lit("age"))))
        .when(k == 9, F.array(F.array(F.lit("age"), F.lit("hppd")), F.array(F.lit("only"))))
        .when(k == 11, F.array(F.array(F.lit("age"), F.lit("hppd")), F.array(F.lit("sev"), F.lit("hppd"))))
    )
    trial_ok = '{"time_zero":"admission","follow_up":{"horizon_hours":48,"anchor":"time_zero","mode":"fixed"}}'
    specs = t.raw("part").select(
        "p_partkey",
        F.when(k != 0, F.lit(" hppd ")).alias("treatment"),
        F.lit("delta_ri").alias("outcome"),
        F.when(k == 8, F.array(F.lit("age"))).when(k.isin(9, 11), F.array(F.lit("age"), F.lit("sev"), F.lit(""))).when(k == 7, F.array(F.lit("age"))).alias("confounders"),
        edges.alias("dag_edges"),
        F.when(k == 7, F.array(F.lit("age"))).alias("post_treatment"),
        temporal.alias("temporal_spec"),
        F.when(k == 1, F.lit(trial_ok)).when(k == 3, F.lit(trial_ok.replace("48", "0"))).alias("target_trial"),
    )
    return emit(G.causal_temporal_order(specs).select("p_partkey", "causal_warnings", "causal_status", "post_treatment_feature_leakage"))


@query(
    "protocol_hash",
    """WITH x AS (SELECT p_partkey, sha256('{"a":{"b":1,"c":"' || p_brand || '"},"treatment":"' || p_type || '"}') AS h,
       sha256('{"a":{"b":1,"c":"' || p_brand || '"},"treatment":"other"}') AS o FROM part)
    SELECT p_partkey, h AS protocol_hash, CASE WHEN p_partkey % 4 = 1 THEN 'client_hash_mismatch' WHEN p_partkey % 3 = 0 THEN 'stored_spec_mismatch' ELSE 'ok' END AS hash_status FROM x""",
)
def _(t: Tables) -> DataFrame:
    part = t.raw("part").withColumn("spec_id", F.col("p_partkey"))
    text = lambda treatment, extra: F.concat(
        F.lit('{"treatment": "'), treatment, F.lit('", '), extra, F.lit('"a": {"c": "'), F.col("p_brand"), F.lit('", "b": 1}}')
    )
    stored = part.filter(F.col("p_partkey") % 5 != 0).select(
        "spec_id", text(F.when(F.col("p_partkey") % 3 == 0, F.lit("other")).otherwise(F.col("p_type")), F.lit("")).alias("spec")
    )
    stored = stored.unionByName(
        part.filter(F.col("p_partkey") % 5 == 0).select(
            "spec_id", text(F.when(F.col("p_partkey") % 3 == 0, F.lit("other")).otherwise(F.col("p_type")), F.lit('"protocol_hash": "z", ')).alias("spec")
        )
    )
    requests = part.select(
        "p_partkey", "spec_id", text(F.col("p_type"), F.lit('"protocol_hash": "old", ')).alias("spec"), F.when(F.col("p_partkey") % 4 == 1, F.lit("beef")).alias("client_hash")
    )
    return G.check_protocol_hash(requests, stored).select("p_partkey", "protocol_hash", "hash_status")
