"""Registered queries of the governed aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caretrace.operators import aggregate as A
from caretrace.plans import windows as WP
from caretrace.plans.adapter import Tables
from caretrace.plans.base import emit, query, rnd

KEY_SQL = {
    "unit": "CAST(unit_id AS STRING)",
    "date": "substr(start_dt, 1, 10)",
    "shift": "'unit:' || CAST(unit_id AS STRING) || '|date:' || substr(start_dt, 1, 10)",
    "window": "window_id",
    "patient": "patient_key",
    "row": "CAST(row_id AS STRING)",
}
W_SQL = "CASE WHEN severity_weight = 0 THEN 1 ELSE severity_weight END * exposure_share"
ON_SQL = "score IS NOT NULL AND status = 'complete'"


@query("group_key", " UNION ALL ".join(f"SELECT '{g}' AS group_by, row_id, {s} AS \"group\" FROM v_scored" for g, s in KEY_SQL.items()))
def _(t: Tables) -> DataFrame:
    keys = F.array(*[F.struct(F.lit(g).alias("group_by"), A.group_key(t.scored.columns, g).alias("group")) for g in KEY_SQL])
    return t.scored.select("row_id", F.inline(keys))


@query(
    "weighted_score",
    f"""SELECT CAST(unit_id AS STRING) AS "group", {rnd(f'sum(score * {W_SQL}) FILTER (WHERE {ON_SQL}) / (sum({W_SQL}) FILTER (WHERE {ON_SQL}) + 1e-6)', 'score')},
    {rnd(f'coalesce(sum({W_SQL}) FILTER (WHERE {ON_SQL}), 0)', 'total_weight')} FROM v_scored GROUP BY 1""",
)
def _(t: Tables) -> DataFrame:
    return emit(A.weighted_score(t.scored, group_by="unit"))


MEANS_SQL = " UNION ALL ".join(
    f"""SELECT CAST(unit_id AS STRING) AS "group", '{c}' AS component, {rnd(f'sum(c_{c} * {W_SQL}) / sum({W_SQL})', 'mean')} FROM v_scored WHERE {ON_SQL} AND c_{c} IS NOT NULL GROUP BY 1"""
    for c in ("benefit", "quality")
)


@query("component_means", MEANS_SQL)
def _(t: Tables) -> DataFrame:
    return emit(A.component_means(t.scored, group_by="unit"))


def band_sql(key: str, digits: int = 6) -> str:
    return f"""SELECT g, {', '.join(rnd(f'min(score) FILTER (WHERE acc >= {q} * tot)', n, digits) for q, n in A.BAND)} FROM
 (SELECT *, sum(w) OVER (PARTITION BY g ORDER BY score ROWS UNBOUNDED PRECEDING) AS acc, sum(w) OVER (PARTITION BY g) AS tot FROM (SELECT {key} AS g, score, {W_SQL} AS w FROM v_scored WHERE {ON_SQL})) GROUP BY g"""


@query("weighted_quantile", f"""SELECT g AS "group", p10, p50, p90 FROM ({band_sql(KEY_SQL['unit'])})""")
def _(t: Tables) -> DataFrame:
    return emit(A.weighted_quantile(t.scored, group_by="unit"))


def std_sql(key: str) -> str:
    return f"""SELECT g, {rnd('sqrt(sum(w * (score - mu) * (score - mu)) / sum(w))', 'weighted_std')} FROM
 (SELECT *, sum(score * w) OVER (PARTITION BY g) / sum(w) OVER (PARTITION BY g) AS mu FROM (SELECT {key} AS g, score, {W_SQL} AS w FROM v_scored WHERE {ON_SQL})) GROUP BY g"""


@query("weighted_std", f"""SELECT g AS "group", weighted_std FROM ({std_sql(KEY_SQL['unit'])})""")
def _(t: Tables) -> DataFrame:
    return emit(A.weighted_std(t.scored, group_by="unit"))


def profile_sql(key: str) -> str:
    n = lambda s: f"count(*) FILTER (WHERE status = '{s}')"
    return f"""SELECT {key} AS g, count(*) AS n_observations, {n('complete')} AS n_scored_aggregate, {n('provisional')} AS n_provisional, {n('insufficient_evidence')} AS n_insufficient_evidence,
 0 AS n_contract_mismatch, 0 AS n_low_feature_coverage, 0 AS n_shadow_only, {rnd(f"count(*) FILTER (WHERE {ON_SQL}) / count(*)", 'coverage')}, {rnd(n('provisional') + ' / count(*)', 'provisional_fraction')},
 {rnd(n('complete') + ' / count(*)', 'complete_fraction')}, {rnd(n('insufficient_evidence') + ' / count(*)', 'insufficient_fraction')} FROM v_scored GROUP BY 1"""


@query("status_profile", f"""SELECT g AS "group", * EXCLUDE (g) FROM ({profile_sql(KEY_SQL['date'])})""")
def _(t: Tables) -> DataFrame:
    return emit(A.status_profile(t.scored, group_by="date"))


def support_sql(key: str) -> str:
    return f"SELECT {key} AS g, count(*) AS n_observations, count(DISTINCT episode_id) AS n_episodes, count(DISTINCT staff) AS n_staff FROM v_scored GROUP BY 1"


@query("support_counts", f"""SELECT g AS "group", * EXCLUDE (g) FROM ({support_sql(KEY_SQL['date'])})""")
def _(t: Tables) -> DataFrame:
    return emit(A.support_counts(t.scored, group_by="date"))


def reasons_sql(staff: bool) -> str:
    extra = ", CASE WHEN n_staff < 5 THEN 'n_staff_below_min_staff_count' END" if staff else ""
    return f"""list_filter([CASE WHEN n_observations < 10 THEN 'n_observations_below_min_cell_count' END, CASE WHEN n_episodes < 10 THEN 'n_episodes_below_min_cell_count' END{extra}], lambda x: x IS NOT NULL)"""


@query(
    "suppress_low_support",
    f"""SELECT g AS "group", n_observations, n_episodes, n_staff, array_to_string({reasons_sql(True)}, '|') AS suppression_reasons, len({reasons_sql(True)}) > 0 AS suppressed,
    CASE WHEN len({reasons_sql(True)}) = 0 THEN score END AS score FROM ({support_sql(KEY_SQL['date'])}) JOIN
    (SELECT substr(start_dt, 1, 10) AS g, {rnd(f'sum(score * {W_SQL}) FILTER (WHERE {ON_SQL}) / (sum({W_SQL}) FILTER (WHERE {ON_SQL}) + 1e-6)', 'score')} FROM v_scored GROUP BY 1) USING (g)""",
)
def _(t: Tables) -> DataFrame:
    cells = A.support_counts(t.scored, group_by="date").join(A.weighted_score(t.scored, group_by="date").select("group", "score"), "group")
    return emit(A.suppress_low_support(cells, ["score"], need_staff=True))


def cells_sql(key: str, staff: bool, mix: bool) -> str:
    mix_list = "['case_mix_insufficient', 'missing_case_mix_spec', 'no_comparable_without_case_mix']" if mix else "[]"
    return f"""SELECT p.g AS "group", CASE WHEN hid THEN 'suppressed_low_support' WHEN s.score IS NOT NULL THEN 'scored_aggregate' ELSE 'insufficient_evidence' END AS status, CASE WHEN NOT hid THEN s.score END AS score,
 CASE WHEN NOT hid THEN p10 END AS p10, CASE WHEN NOT hid THEN p50 END AS p50, CASE WHEN NOT hid THEN p90 END AS p90, CASE WHEN NOT hid THEN weighted_std END AS weighted_std, n_observations, n_episodes, n_staff, coverage,
 CASE WHEN hid THEN n_observations ELSE 0 END AS n_suppressed_low_support, hid AS suppressed, array_to_string(reasons, '|') AS suppression_reasons,
 array_to_string(list_sort(list_distinct(list_concat(coalesce(notes, []), {mix_list}, CASE WHEN hid THEN list_append(reasons, 'suppressed_low_support') ELSE [] END))), '|') AS warnings
FROM (SELECT *, len(reasons) > 0 AS hid FROM (SELECT *, {reasons_sql(staff)} AS reasons FROM ({profile_sql(key)}) JOIN (SELECT * EXCLUDE (n_observations) FROM ({support_sql(key)})) USING (g))) p
LEFT JOIN (SELECT {key} AS g, {rnd(f'sum(score * {W_SQL}) FILTER (WHERE {ON_SQL}) / (sum({W_SQL}) FILTER (WHERE {ON_SQL}) + 1e-6)', 'score')} FROM v_scored GROUP BY 1) s USING (g)
LEFT JOIN ({band_sql(key)}) b USING (g) LEFT JOIN ({std_sql(key)}) d USING (g)
LEFT JOIN (SELECT g, list(DISTINCT w) AS notes FROM (SELECT {key} AS g, unnest(warnings) AS w FROM v_scored) GROUP BY 1) n USING (g)"""


CELL_COLS = ["group", "status", "score", "p10", "p50", "p90", "weighted_std", "n_observations", "n_episodes", "n_staff", "coverage"]
CELL_COLS += ["n_suppressed_low_support", "suppressed", "suppression_reasons", "warnings"]
NO_CASE_MIX = ["case_mix_insufficient", "missing_case_mix_spec"]


@query("aggregate_scores", cells_sql(KEY_SQL["shift"], True, True))
def _(t: Tables) -> DataFrame:
    group_by, _, need_staff = A.safe_grouping("shift", grain="window")
    return emit(A.aggregate_scores(t.scored, group_by=group_by, need_staff=need_staff, case_mix_warnings=NO_CASE_MIX).select(*CELL_COLS))


@query("aggregate_scores_unit", cells_sql(KEY_SQL["unit"], False, True))
def _(t: Tables) -> DataFrame:
    # A nurse grouping would single people out: it becomes the unit grouping.
    group_by, _, need_staff = A.safe_grouping("nurse", grain="episode")
    return emit(A.aggregate_scores(t.scored, group_by=group_by, need_staff=need_staff, case_mix_warnings=NO_CASE_MIX).select(*CELL_COLS))


@query(
    "writeback_list",
    """WITH r AS (SELECT CASE WHEN l_suppkey % 9 = 4 AND NOT (l_linenumber = 7 AND l_quantity < 2) THEN 'retired' ELSE 'm' || CAST(l_suppkey AS STRING) END AS model_id, any_value(l_suppkey) AS k, count(*) AS n,
      count(*) FILTER (WHERE l_returnflag = 'R') AS a, count(*) FILTER (WHERE l_linestatus = 'F' AND l_linenumber = 1 AND l_quantity < 5) AS o FROM lineitem GROUP BY 1)
    SELECT model_id, CASE WHEN n >= 10 THEN n END AS "count", CASE WHEN n >= 10 AND NOT (a > 0 AND a < 10) THEN a END AS attempted, CASE WHEN n >= 10 AND NOT (o > 0 AND o < 10) THEN o END AS ok, n < 10 AS suppressed,
    CASE WHEN n < 10 THEN 'suppressed_low_support' ELSE 'aggregate_only' END AS status, (SELECT CAST(sum(n) AS BIGINT) FROM r WHERE k % 3 = 0 OR model_id = 'retired') AS blocked_model_records FROM r WHERE k % 3 <> 0 AND model_id <> 'retired'""",
)
def _(t: Tables) -> DataFrame:
    # Most records of some suppliers belong to a retired model, which leaves those suppliers with thin cells.
    moved = (F.col("l_suppkey") % 9 == 4) & ~((F.col("l_linenumber") == 7) & (F.col("l_quantity") < 2))
    records = t.raw("lineitem").select(
        F.when(moved, F.lit("retired")).otherwise(F.concat(F.lit("m"), "l_suppkey")).alias("model_id"),
        (F.col("l_returnflag") == "R").alias("attempted"),
        ((F.col("l_linestatus") == "F") & (F.col("l_linenumber") == 1) & (F.col("l_quantity") < 5)).alias("ok"),
    )
    models = t.raw("supplier").select(F.concat(F.lit("m"), "s_suppkey").alias("model_id"), (F.col("s_suppkey") % 3 != 0).alias("defensible"))
    return emit(A.writeback_list(records, models))


@query(
    "governance_columns",
    f"""SELECT c."group", c.suppressed, (SELECT count(*) FROM ({cells_sql(KEY_SQL['date'], False, False)}) WHERE suppressed) AS suppressed_cells, true AS non_individual_use, true AS shadow_mode, 'date' AS aggregation_level,
    10 AS min_cell_count, 'composite_v1' AS formula_version, 'm1' AS model_id, (SELECT count(*) FROM ({cells_sql(KEY_SQL['date'], False, False)}) WHERE suppressed) > 0 AS summary_redacted FROM ({cells_sql(KEY_SQL['date'], False, False)}) c""",
)
def _(t: Tables) -> DataFrame:
    cells = A.support_counts(t.scored, group_by="date")
    cut = A.suppress_low_support(cells, []).select("group", "suppressed")
    return emit(A.governance_columns(cut, level="date", formula_version="composite_v1", model_id="m1"))


@query(
    "dashboard_counts",
    """SELECT 'episodes' AS name, count(*) AS n FROM v_episode UNION ALL SELECT 'raw_fhir', count(*) FROM v_raw UNION ALL SELECT 'roster_shifts', count(*) FROM v_shift UNION ALL SELECT 'observations', count(*) FROM v_obs
    UNION ALL SELECT 'conditions', CASE WHEN count(*) BETWEEN 1 AND 9 THEN NULL ELSE count(*) END FROM region UNION ALL SELECT 'procedures', count(*) FROM v_proc UNION ALL SELECT 'dataset_rows', count(*) FROM v_episode
    UNION ALL SELECT 'windows', count(*) FROM v_window UNION ALL SELECT 'window_rows', count(*) FROM v_window UNION ALL SELECT 'audit_events', count(*) FROM conversations
    UNION ALL SELECT 'governance_decisions', count(*) FROM region UNION ALL SELECT 'writebacks', count(*) FROM lineitem""",
)
def _(t: Tables) -> DataFrame:
    w = WP.windows(t)
    tables = {
        "episodes": t.episodes,
        "raw_fhir": t.raw_resources,
        "roster_shifts": t.shifts,
        "observations": t.observations,
        "conditions": t.raw("region"),
        "procedures": t.procedures,
        "dataset_rows": t.episodes,
        "windows": w,
        "window_rows": w,
        "audit_events": t.raw("conversations"),
        "governance_decisions": t.raw("region"),
        "writebacks": t.raw("lineitem"),
    }
    return A.dashboard_counts(tables)


@query("roster_summary", "SELECT count(*) AS roster_shifts, count(DISTINCT unit_id) AS units_with_roster FROM v_shift")
def _(t: Tables) -> DataFrame:
    return A.roster_summary(t.shifts)


@query(
    "economic_projection",
    f"""WITH c AS (SELECT CAST(unit_id AS STRING) AS "group", sum(score * {W_SQL}) FILTER (WHERE {ON_SQL}) / (sum({W_SQL}) FILTER (WHERE {ON_SQL}) + 1e-6) - 50 AS d FROM v_scored GROUP BY 1)
    SELECT "group", {rnd('-0.12 * d', 'delta_los_days', 5)}, {rnd('0.12 * d * 900', 'bed_day_savings', 5)}, {rnd('0.12 * d * 900 - 250', 'net_savings', 5)} FROM c""",
)
def _(t: Tables) -> DataFrame:
    cells = A.weighted_score(t.scored, group_by="unit").select("group", (F.col("score") - 50).alias("delta"))
    return emit(A.economic_projection(cells, extra_cost=250.0).drop("delta"), digits=5)
