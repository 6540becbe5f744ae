"""Follow-up records: initial state, evidence since a base time, current state, rescoring, summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caretrace import constants as C
from caretrace.functions.columns import compact, sorted_unique, string_array, tag_if
from caretrace.functions.tables import latest_by
from caretrace.operators import aggregate as A

RECORD_KEYS = ["episode_id", "model_id", "formula_version", "formula_hash"]
MODEL_EVIDENCE_WARNING = "writeback_summary_model_not_defensible"


def initial_state(status: Column) -> Column:
    return (
        F.when(status == "provisional", F.lit("immediate_provisional"))
        .when(status.isin("complete", "failed"), status)
        .otherwise(F.lit("insufficient_evidence"))
    )


def followup_status(state: Column) -> Column:
    return F.when(state.isin("failed", "insufficient_evidence"), state).otherwise(F.lit("pending_followup"))


def reliability_warnings(shares: Column, reliability: Column) -> Column:
    weak = (F.coalesce(reliability, F.lit(0.0)) < 0.60) | F.coalesce(F.size(shares) == 0, F.lit(True))
    return F.concat(string_array(["non_individual_use_team_or_unit_only"]), compact(tag_if(weak, "low_support")))


def initial_followup(scored: DataFrame, existing: DataFrame) -> DataFrame:
    """New records for keys that have none yet; keys already present are left alone."""
    fresh = scored.join(existing.select(*RECORD_KEYS), RECORD_KEYS, "left_anti")
    state = initial_state(F.col("status"))
    return fresh.withColumns(
        {
            "initial_state": state,
            "followup_status": followup_status(state),
            "current_state": state,
            "warnings": sorted_unique(F.concat("warnings", reliability_warnings(F.col("staff_shares"), F.col("staff_reliability")))),
        }
    )


def evaluate_followup(
    records: DataFrame, *, observations: DataFrame, procedures: DataFrame, windows: DataFrame, writebacks: DataFrame
) -> DataFrame:
    """Evidence totals, counts newer than the base time, latest times and the next status per record.

    ``records``: record_id, episode_id, model_id, base_time, discharge, has_target, target,
    snapshot_hash, stored_hash, enriched, last_rescore_at, staff_shares, staff_reliability.
    The four evidence tables are reduced per record before they are joined.
    """
    base = records.select("record_id", "episode_id", "model_id", "base_time")

    def counted(evidence: DataFrame, ts: str, name: str, keys: Sequence[str] = ("episode_id",)) -> DataFrame:
        rows = evidence.select(*keys, F.col(ts).alias("_t")).filter(F.col("_t").isNotNull())
        newer = F.col("base_time").isNull() | (F.col("_t") > F.col("base_time"))
        return rows.join(base, list(keys)).groupBy("record_id").agg(
            F.count(F.lit(1)).alias(f"total_{name}"), F.count_if(newer).alias(f"new_{name}"), F.max("_t").alias(f"latest_{name}")
        )

    parts = [
        counted(observations, "effective_dt", "obs"),
        counted(procedures, "performed_dt", "proc"),
        counted(windows, "end_dt", "windows"),
        counted(writebacks, "created_at", "writebacks", ("episode_id", "model_id")),
    ]
    out = records
    for p in parts:
        out = out.join(p, "record_id", "left")
    names = ("obs", "proc", "windows", "writebacks")
    out = out.withColumns({f"{k}_{n}": F.coalesce(F.col(f"{k}_{n}"), F.lit(0)) for k in ("total", "new") for n in names})
    out = out.withColumn("outcome_available", F.col("has_target") | ((F.col("target") == "delta_ri") & F.col("discharge").isNotNull()))
    out = out.withColumn(
        "feature_snapshot_changed",
        F.coalesce((F.col("snapshot_hash") != "") & (F.col("snapshot_hash") != F.coalesce("stored_hash", F.lit(""))), F.lit(False)),
    )
    kinds = compact(
        tag_if(F.col("outcome_available"), "episode_outcome"),
        tag_if(F.col("total_obs") > 0, "normalized_observations"),
        tag_if(F.col("total_proc") > 0, "normalized_procedures"),
        tag_if(F.col("total_windows") > 0, "window_features"),
        tag_if(F.col("total_writebacks") > 0, "fhir_writeback"),
    )
    fresh = compact(
        tag_if(F.col("new_obs") > 0, "normalized_observations"),
        tag_if(F.col("new_proc") > 0, "normalized_procedures"),
        tag_if(F.col("new_windows") > 0, "window_features"),
        tag_if(F.col("feature_snapshot_changed"), "feature_snapshot"),
    )
    out = out.withColumn("evidence_types", kinds).withColumn("new_evidence_types", fresh)
    enough = F.col("outcome_available") & (F.size("new_evidence_types") > 0)
    out = out.withColumn("sufficient_for_rescore", enough)
    silent = (F.col("total_obs") == 0) & (F.col("total_proc") == 0) & (F.col("total_windows") == 0)
    return out.withColumns(
        {
            "followup_status": F.when(F.col("enriched") & F.col("last_rescore_at").isNotNull() & ~F.col("sufficient_for_rescore"), F.lit("enriched_followup"))
            .when(F.col("sufficient_for_rescore"), F.lit("stale"))
            .when(F.size("evidence_types") > 0, F.lit("insufficient_evidence"))
            .otherwise(F.lit("pending_followup")),
            "last_followup_at": F.greatest("discharge", "latest_obs", "latest_proc", "latest_windows", "latest_writebacks"),
            "evaluation_warnings": sorted_unique(
                F.concat(
                    reliability_warnings(F.col("staff_shares"), F.col("staff_reliability")),
                    compact(
                        tag_if(~F.col("outcome_available"), "followup_outcome_unavailable"),
                        tag_if(F.size("new_evidence_types") == 0, "no_new_supported_followup_evidence"),
                        tag_if(silent, "followup_signals_missing"),
                    ),
                )
            ),
        }
    )


def current_state(status: Column, enriched: Column, initial: Column) -> Column:
    return (
        F.when((status == "enriched_followup") & enriched, F.lit("enriched_followup"))
        .when(status.isin("stale", "failed", "insufficient_evidence", "governance_blocked"), status)
        .otherwise(F.coalesce(F.nullif(initial, F.lit("")), F.lit("pending_followup")))
    )


def rescore_candidates(evaluated: DataFrame, rescored: DataFrame, history: DataFrame) -> DataFrame:
    """Latest record per key after rescoring.

    ``rescored`` holds (record_id, score, status, scored_at) of the scoring plan run on the sufficient
    records. A blocked rescore (no status) keeps the earlier enriched result; older results stay in
    ``history`` and are linked by record_id.
    """
    due = evaluated.filter("sufficient_for_rescore").select("record_id")
    fresh = rescored.join(due, "record_id", "left_semi").select(
        "record_id", "score", F.when(F.col("status").isNull(), F.lit("governance_blocked")).otherwise(F.lit("enriched_followup")).alias("followup_status"), "scored_at"
    )
    log = history.select("record_id", "score", "followup_status", "scored_at").unionByName(fresh)
    last = latest_by(log, ["record_id"], ["scored_at"])
    kept = log.filter(F.col("followup_status") == "enriched_followup")
    best = latest_by(kept, ["record_id"], ["scored_at"]).select("record_id", F.col("score").alias("enriched_score"))
    return last.drop("score").join(best, "record_id", "left")


def feature_snapshot_hash(schema_hash: Column, version: Column, features: Column, target: Column) -> Column:
    """SHA-256 over schema hash, version, features and target as sorted JSON."""
    body = F.struct(features.alias("features"), version.alias("feature_version"), schema_hash.alias("schema_hash"), target.alias("target"))
    return F.sha2(F.to_json(body), 256)


STATES = ("immediate_provisional", "complete", "enriched_followup", "insufficient_evidence", "governance_blocked", "stale", "failed")


def writeback_gate(records: DataFrame, *, model_id: str, defensible: bool, models: DataFrame) -> DataFrame:
    """One row ``detail``: NULL when the records may be aggregated, else the first reason.

    ``models`` is (model_id, defensible); records carry baseline_model_id (NULL = none).
    """
    base = F.coalesce("baseline_model_id", F.lit(""))
    facts = records.agg(
        F.coalesce(F.bool_or(F.col("model_id") != model_id), F.lit(False)).alias("mixed_models"),
        F.count_distinct(base).alias("n_base"),
        F.max(base).alias("base"),
    )
    known = models.select(F.col("model_id").alias("base"), F.col("defensible").alias("ok"))
    judged = facts.join(known, "base", "left")
    return judged.select(
        F.when(F.col("mixed_models"), F.lit("mixed_models_not_aggregable"))
        .when(F.lit(not defensible), F.lit("model_not_defensible"))
        .when(F.col("n_base") > 1, F.lit("mixed_baseline_models_not_aggregable"))
        .when((F.col("base") != "") & F.col("ok").isNull(), F.lit("baseline_model_not_found"))
        .when((F.col("base") != "") & ~F.col("ok"), F.lit("baseline_model_not_defensible"))
        .alias("detail")
    )


def writeback_summary(records: DataFrame, *, group_by: str, gate: DataFrame, epsilon: float = C.EPS) -> DataFrame:
    """Governed cells over the enriched-else-initial results; no rows when the gate has a reason.

    Records carry the scored-row columns twice, as structs ``initial`` and ``enriched``.
    """
    effective = "unit" if group_by in ("team", "shift") else group_by
    better = F.col("enriched").isNotNull()
    columns = records.schema["initial"].dataType.names
    rows = records.select("record_id", *[F.when(better, F.col(f"enriched.{c}")).otherwise(F.col(f"initial.{c}")).alias(c) for c in columns])
    cells = A.aggregate_scores(rows, group_by=effective, epsilon=epsilon, need_staff=group_by in ("team", "shift"))
    return cells.withColumn("_why", gate.scalar()).filter(F.col("_why").isNull()).drop("_why")


def state_counts(records: DataFrame) -> DataFrame:
    first = F.count_if(F.col("initial_state") == STATES[0]).alias(STATES[0])
    return records.agg(F.count(F.lit(1)).alias("records"), first, *[F.count_if(F.col("current_state") == s).alias(s) for s in STATES[1:]])


def patient_summary(records: DataFrame, models: DataFrame) -> DataFrame:
    """Redacted export of every record: states, warnings and provenance, never a number."""
    judged = records.join(models.select("model_id", "defensible"), "model_id", "left")
    weak = ~F.coalesce("defensible", F.lit(False))
    return judged.select(
        "record_id",
        "episode_id",
        "model_id",
        F.lit(None).cast("string").alias("patient_key"),
        "initial_state",
        "followup_status",
        "current_state",
        F.lit(None).cast("double").alias("score"),
        F.lit(None).cast("double").alias("delta_score"),
        F.lit(True).alias("score_suppressed"),
        sorted_unique(F.concat("warnings", compact(tag_if(weak, MODEL_EVIDENCE_WARNING)))).alias("warnings"),
        F.lit(False).alias("operational_score"),
    )
