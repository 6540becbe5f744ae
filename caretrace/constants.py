"""Fixed values that results depend on."""

# Temporal specification.
TEMPORAL_SPEC_VERSION = "temporal_v1"
TEMPORAL_FIELDS = (
    "censoring_reason",
    "feature_window_end",
    "feature_window_start",
    "index_time",
    "outcome_window_end",
    "outcome_window_start",
    "temporal_spec_version",
)
STATUS_LEGACY = "legacy_outcome_not_defensible"
STATUS_DEFENSIBLE = "defensible_fixed_horizon"
STATUS_INSUFFICIENT_OUTCOME = "insufficient_outcome_evidence"

# Predictor names that only exist after the outcome.
POST_OUTCOME_NAMES = ("discharge_date", "discharge_disposition", "discharge_status", "length_of_stay", "los", "ri_final")

# Case-mix domains and the column names that can stand for them.
CASE_MIX_DOMAINS = ("age", "baseline_load", "baseline_risk", "comorbidity", "fragility_or_dependency", "severity")
CASE_MIX_COLUMNS = {
    "age": ("age", "patient_age", "age_years"),
    "severity": ("ri_initial", "baseline_severity", "severity", "rothman_index_initial"),
    "comorbidity": ("charlson", "charlson_index", "comorbidity_index", "comorbidity_count"),
    "fragility_or_dependency": ("frailty", "frailty_score", "fragility", "dependency", "dependency_score", "adl", "barthel"),
    "baseline_risk": ("baseline_risk", "predicted_baseline_risk", "ri_initial"),
    "baseline_load": ("baseline_load", "patient_census", "unit_census", "census", "nurse_hppd"),
}

# LOINC codes.
ACUITY_CODE = "85556-9"
VITALS = {
    "8867-4": "hr",
    "8480-6": "sbp",
    "8462-4": "dbp",
    "8310-5": "temp",
    "59408-5": "spo2",
    "9279-1": "resp_rate",
}
COMPONENT_CODES = (
    "8867-4", "8480-6", "8462-4", "8478-0", "9279-1", "8310-5", "59408-5", "3150-0", "3151-8", "9192-6",
    "6690-2", "718-7", "4544-3", "2951-2", "2823-3", "3094-0", "2160-0", "2345-7", "2075-0", "2028-9",
    "6768-6", "1751-7", "9269-2", "38226-6", "41959-4", "72514-3",
)
LOINC_DISPLAY = {
    "85556-9": "Rothman Index Calculated",
    "8867-4": "Heart rate",
    "8480-6": "Systolic blood pressure",
    "8462-4": "Diastolic blood pressure",
    "8478-0": "Mean blood pressure",
    "8310-5": "Body temperature",
    "59408-5": "Oxygen saturation in Arterial blood by Pulse oximetry",
    "9279-1": "Respiratory rate",
    "3150-0": "Inhaled oxygen concentration",
    "3151-8": "Oxygen flow rate",
    "9192-6": "Urine output",
    "6690-2": "Leukocytes [#/volume] in Blood",
    "718-7": "Hemoglobin [Mass/volume] in Blood",
    "4544-3": "Hematocrit [Volume Fraction] of Blood",
    "2951-2": "Sodium [Moles/volume] in Serum or Plasma",
    "2823-3": "Potassium [Moles/volume] in Serum or Plasma",
    "3094-0": "Urea nitrogen [Mass/volume] in Serum or Plasma",
    "2160-0": "Creatinine [Mass/volume] in Serum or Plasma",
    "2345-7": "Glucose [Mass/volume] in Serum or Plasma",
    "2075-0": "Chloride [Moles/volume] in Serum or Plasma",
    "2028-9": "Carbon dioxide, total [Moles/volume] in Serum or Plasma",
    "6768-6": "Platelets [#/volume] in Blood",
    "1751-7": "Albumin [Mass/volume] in Serum or Plasma",
    "9269-2": "Glasgow coma score total",
    "38226-6": "Braden scale total score",
    "41959-4": "Morse fall scale total score",
    "72514-3": "Pain severity - 0-10 verbal numeric rating",
}

# Role text patterns.
NURSE_ROLE_PATTERN = "(nurs|rn|enfermer|tcae|aux)"
NURSING_KEYWORD_PATTERN = "nurs|rn|enfermer|matrona|auxiliar|tcae"

# Resource types and patterns of the clinical bundle rules.
RESOURCE_TYPES = (
    "Bundle", "Patient", "Encounter", "Observation", "Condition", "Procedure",
    "Practitioner", "PractitionerRole", "RiskAssessment",
)
RESOURCE_ID_PATTERN = r"^[A-Za-z0-9\-.]{1,64}$"
REFERENCE_PATTERN = (
    r"^(Patient|Encounter|Observation|Condition|Procedure|Practitioner|PractitionerRole|RiskAssessment)"
    r"/[A-Za-z0-9\-.]{1,64}$"
)

# Support limits.
MIN_CELL = 10
MIN_STAFF = 5
EPS = 1e-6

# Composite score.
COMPONENTS = ("benefit", "attribution", "causal", "quality", "uncertainty")
REQUIRED_COMPONENTS = ("benefit", "attribution", "quality", "uncertainty")
UNCERTAINTY_WEIGHTS = {"conformal_width": 0.35, "missingness": 0.35, "ood": 0.20, "low_support": 0.10}
OUTCOME_GOAL_RULES = (
    (("delta_ri", "ri_final", "recovery", "utility"), "higher_is_better"),
    (
        (
            "mortality", "fall", "pressure_injury", "pressure_ulcer", "upp", "infection", "readmission",
            "deterioration", "length_of_stay", "los",
        ),
        "lower_is_better",
    ),
)
SCORED_STATUSES = ("complete", "scored_aggregate")

# Model evidence.
INTENDED_USE = "shadow_aggregate_research"
REQUIRED_LIMITATIONS = ("not_for_individual_decisioning", "not_mdr_production_ready", "shadow_aggregate_research_only")
MINIMUM_LIMITATIONS = (
    "shadow_aggregate_research_only",
    "not_for_individual_decisioning",
    "not_clinically_validated",
    "not_mdr_production_ready",
)
GUARD_PASSED = ("passed", "temporal_spec_valid", "temporal_guardrails_passed")
GUARD_NOT_EVALUATED = (
    "",
    "unknown",
    "not_evaluated",
    "not_evaluated_external_payload",
    "external_payload_temporal_not_defensible",
)
OUTCOME_COMPARABILITY_WARNINGS = (
    "mixed_outcome_horizons",
    "mixed_temporal_spec_versions",
    "outcome_definition_not_comparable",
    "outcome_window_not_unique",
)
BLOCKING_FEATURE_WARNINGS = ("declared_feature_missing_from_payload", "declared_feature_without_observed_values")

# Audit payload fields that may be kept.
AUDIT_FIELDS = (
    "action", "baseline_model_id", "caller_hash", "caller_kind", "effective_group_by", "endpoint", "error_code",
    "evidence_status", "formula_version", "grain", "model_id", "method", "requested_group_by", "request_hash",
    "role", "row_count", "status", "suppressed", "suppressed_cells", "unit_id",
)
