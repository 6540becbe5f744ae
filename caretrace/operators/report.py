"""Fairness audit, eligibility, exclusions, cohort flow and quality playbook."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caretrace import constants as C
from caretrace.functions.columns import nan_to_null
from caretrace.functions.quantiles import exact_medians
from caretrace.functions.tables import stat_columns, with_stats

# --- fairness --------------------------------------------------------------------------------


def age_bands(age: Column) -> Column:
    """Right-closed bands; a missing age is the text 'nan'."""
    a = nan_to_null(age.try_cast("double"))
    return (
        F.when(a.isNull(), F.lit("nan"))
        .when(a <= 17, F.lit("<=17"))
        .when(a <= 39, F.lit("18-39"))
        .when(a <= 64, F.lit("40-64"))
        .when(a <= 79, F.lit("65-79"))
        .otherwise(F.lit("80+"))
    )


AGE_NAMES = ("age", "edad", "patient_age")


def sensitive_group(column: str) -> Column:
    return age_bands(F.col(column)) if column.lower() in AGE_NAMES else F.coalesce(F.col(column).cast("string"), F.lit("nan"))


def binary_decision(df: DataFrame, column: str, *, threshold: float | None = None, keep_binary: bool = True, out: str = "_d") -> DataFrame:
    """Adds a 0/1 column: 0/1 values are kept, anything else is split at the threshold or the median (>=)."""
    v = nan_to_null(F.col(column).cast("double"))
    if threshold is not None:
        return df.withColumn(out, F.coalesce((v >= float(threshold)).cast("int"), F.lit(0)))
    odd = df.agg(F.count_if(v.isNotNull() & ~v.isin(0.0, 1.0)).alias("odd"))
    stats = with_stats(odd, exact_medians(df, {"m": v}), "_m").select("odd", F.col("_m.m").alias("m"))
    cut = with_stats(df, stats, "_cut")
    split = F.coalesce((v >= F.coalesce("_cut.m", F.lit(0.0))).cast("int"), F.lit(0))
    kept = F.when(F.col("_cut.odd") == 0, F.coalesce((v > 0).cast("int"), F.lit(0))).otherwise(split)
    return cut.withColumn(out, kept if keep_binary else split).drop("_cut")


def disparate_impact(df: DataFrame, *, decision: str, sensitive: Sequence[str], min_group: int = 25, threshold: float | None = None) -> DataFrame:
    """(sensitive_feature, group, n, selection_rate, disparate_impact_ratio), large groups first."""
    d = binary_decision(df, decision, threshold=threshold)
    long = d.select("_d", F.inline(F.array(*[F.struct(F.lit(s).alias("sensitive_feature"), sensitive_group(s).alias("group")) for s in sensitive])))
    rates = (
        long.groupBy("sensitive_feature", "group")
        .agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("_d").cast("double")).alias("selection_rate"))
        .filter(F.col("n") >= min_group)
    )
    ratio = rates.groupBy("sensitive_feature").agg(
        F.when((F.count(F.lit(1)) >= 2) & (F.max("selection_rate") > 0), F.min("selection_rate") / F.max("selection_rate")).alias("disparate_impact_ratio")
    )
    return rates.join(ratio, "sensitive_feature", "left").orderBy("sensitive_feature", F.col("n").desc(), "group")


def group_fairness_metrics(df: DataFrame, *, decision: str, label: str | None, sensitive: str) -> DataFrame:
    """One row: demographic parity ratio and difference, equalized odds difference."""
    d = binary_decision(df, decision, keep_binary=False)
    d = binary_decision(d, label, keep_binary=False, out="_y") if label else d.withColumn("_y", F.lit(None).cast("int"))
    per = d.groupBy(F.col(sensitive).cast("string").alias("g")).agg(
        F.avg(F.col("_d").cast("double")).alias("rate"),
        F.avg(F.when(F.col("_y") == 1, F.col("_d").cast("double"))).alias("tpr"),
        F.avg(F.when(F.col("_y") == 0, F.col("_d").cast("double"))).alias("fpr"),
    )
    gap = lambda c: F.max(c) - F.min(c)
    out = per.agg(
        (F.min("rate") / F.nullif(F.max("rate"), F.lit(0.0))).alias("demographic_parity_ratio"),
        gap("rate").alias("demographic_parity_difference"),
        F.greatest(gap("tpr"), gap("fpr")).alias("equalized_odds_difference"),
    )
    return out.select(F.lit(sensitive).alias("sensitive_feature"), *out.columns)


# --- eligibility -----------------------------------------------------------------------------


def eligibility_mask(columns: dict[str, str], expression: Any) -> tuple[Column | None, str | None]:
    """(two-valued predicate, error) of a structured eligibility expression.

    A comparison with a missing value is false, its negation therefore true, and ``!=`` is true.
    """
    if not isinstance(expression, dict):
        return None, "expression_not_a_dict"
    for word, start in (("all", True), ("any", False)):
        if word in expression:
            out = None
            for item in expression[word] or []:
                mask, error = eligibility_mask(columns, item)
                if error:
                    return None, error
                out = mask if out is None else (out & mask if start else out | mask)
            return (F.lit(start) if out is None else out), None
    if "not" in expression:
        mask, error = eligibility_mask(columns, expression.get("not") or {})
        return (None, error) if error else (~mask, None)
    name = str(expression.get("field") or "").strip()
    if not name:
        return None, "missing_field"
    if name not in columns:
        return None, f"unknown_field:{name}"
    op = str(expression.get("op") or "==").strip().lower()
    value, c = expression.get("value"), F.col(name)
    known = nan_to_null(c).isNotNull() if columns[name] in ("double", "float") else c.isNotNull()
    sure = lambda cond: F.coalesce(cond, F.lit(False)) & known
    number = c.try_cast("double")
    if op in (">", ">=", "<", "<=", "between"):
        try:
            low, high = (float(expression.get("min")), float(expression.get("max"))) if op == "between" else (float(value), 0.0)
        except (TypeError, ValueError):
            return None, f"bad_between:{name}" if op == "between" else f"bad_value:{name}"
        compared = {">": number > low, ">=": number >= low, "<": number < low, "<=": number <= low, "between": (number >= low) & (number <= high)}
        return sure(compared[op]), None
    if op in ("==", "!="):
        equal = sure(c == F.lit(value)) if value is not None else F.lit(False)
        return (equal if op == "==" else ~equal), None
    if op in ("in", "not_in"):
        if not isinstance(value, (list, tuple, set)):
            return None, f"bad_value_list:{name}"
        member = sure(c.isin(list(value)))
        return (member if op == "in" else ~member), None
    if op in ("exists", "not_exists"):
        return (known if op == "exists" else ~known), None
    return None, f"unsupported_op:{op}"


def eligibility_filter(df: DataFrame, criteria: Sequence[dict]) -> tuple[DataFrame, DataFrame]:
    """(eligible rows, stages); unsupported criteria keep every row and record why. One pass of counts."""
    columns = dict(df.dtypes)
    mask, counts, notes = F.lit(True), [F.count(F.lit(1)).alias("c0")], []
    for i, item in enumerate(criteria, start=1):
        expression = (item or {}).get("expression")
        if isinstance(expression, dict):
            m, error = eligibility_mask(columns, expression)
        else:
            m, error = None, "no_expression" if expression is None else "expression_string_not_executed"
        mask = mask & m if m is not None else mask
        counts.append(F.count_if(mask).alias(f"c{i}"))
        notes.append((i, str((item or {}).get("description") or "").strip(), error))
    row = df.agg(*counts)
    stages = F.array(
        *[
            F.struct(
                F.lit(i).alias("stage"),
                F.lit(text).alias("description"),
                F.lit(error is None).alias("supported"),
                F.lit(error).cast("string").alias("error"),
                F.col(f"c{i - 1}").alias("n_before"),
                F.col(f"c{i}").alias("n_after"),
                (F.col(f"c{i - 1}") - F.col(f"c{i}")).alias("excluded"),
            )
            for i, text, error in notes
        ]
    )
    return df.filter(mask), row.select(F.inline(stages))


# --- exclusions ------------------------------------------------------------------------------


def gating_flags(columns: Sequence[str], required: Sequence[str]) -> list[str]:
    """Flags that exclude a row: those of required variables and the time-anchored ones, each once."""
    own = [f"missing_{v}" for v in required if f"missing_{v}" in columns]
    timed = [c for c in columns if c.startswith("missing_loinc_") and c.endswith(("_t0", "_t1"))]
    return list(dict.fromkeys([*own, *timed]))


def _set(flag: str) -> Column:
    return F.coalesce(F.col(flag).cast("double") > 0.5, F.lit(False))


def is_excluded(flags: Sequence[str]) -> Column:
    out = F.lit(False)
    for f in flags:
        out = out | _set(f)
    return out


def _decoded(counts: DataFrame) -> DataFrame:
    """flag -> code, display, anchor."""
    anchored = F.regexp_extract("flag", "^missing_loinc_(.*)_(t0|t1)$", 1)
    plain = F.regexp_extract("flag", "^missing_loinc_(.*)$", 1)
    code = F.replace(F.when(anchored != "", anchored).otherwise(plain), F.lit("_"), F.lit("-"))
    names = F.create_map(*[F.lit(x) for pair in C.LOINC_DISPLAY.items() for x in pair])
    return counts.withColumns(
        {"code": code, "display": F.coalesce(F.try_element_at(names, code), F.lit("")), "where": F.regexp_extract("flag", "_(t0|t1)$", 1)}
    )


def _flag_counts(df: DataFrame, flags: Sequence[str], when: Column) -> DataFrame:
    """(flag, excluded) of the rows where ``when`` holds, from one aggregate."""
    row = df.agg(*[F.count_if(when & _set(f)).alias(f"n{i}") for i, f in enumerate(flags)])
    pairs = F.array(*[F.struct(F.lit(f).alias("flag"), F.col(f"n{i}").alias("excluded")) for i, f in enumerate(flags)])
    return row.select(F.inline(pairs)).filter(F.col("excluded") > 0)


def missingness_exclusions(df: DataFrame, *, required: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(kept rows, reasons): flag, excluded, code, display, where; largest first."""
    flags = gating_flags(df.columns, required)
    excluded = is_excluded(flags)
    reasons = _decoded(_flag_counts(df, flags, excluded)).orderBy(F.col("excluded").desc(), "flag")
    return df.filter(~excluded), reasons


def _top(ranked: DataFrame, n: int | None) -> DataFrame:
    return ranked if n is None else ranked.limit(n)


def component_reasons(df: DataFrame, *, required: Sequence[str], top: int | None = None) -> DataFrame:
    """Component flags of excluded rows without an outcome, largest first; ``top`` None gives all."""
    flags = gating_flags(df.columns, required)
    parts = [f for f in flags if f.endswith(("_t0", "_t1")) and "85556_9" not in f]
    counts = _flag_counts(df, parts, is_excluded(flags) & _set("missing_delta_ri"))
    return _top(_decoded(counts).orderBy(F.col("excluded").desc(), "flag"), top)


def component_reasons_long(excluded_windows: DataFrame, components: DataFrame, *, top: int | None = None) -> DataFrame:
    """The same from the long component table: no wide flags are needed."""
    hit = components.filter("missing = 1").join(excluded_windows, ["episode_id", "window_index"], "left_semi")
    counts = hit.groupBy("code", F.col("anchor").alias("where")).agg(F.count(F.lit(1)).alias("excluded"))
    names = F.create_map(*[F.lit(x) for pair in C.LOINC_DISPLAY.items() for x in pair])
    named = counts.withColumn("display", F.coalesce(F.try_element_at(names, F.col("code")), F.lit("")))
    return _top(named.orderBy(F.col("excluded").desc(), "code", "where"), top)


# --- playbook --------------------------------------------------------------------------------

# Groups of codes with one owner each.
ASSESSMENT_CODES = ("9269-2", "38226-6", "41959-4", "72514-3")
VITAL_CODES = ("8867-4", "8480-6", "8462-4", "8478-0", "9279-1", "8310-5", "59408-5", "3150-0", "3151-8", "9192-6")
LAB_CODES = ("6690-2", "718-7", "4544-3", "2951-2", "2823-3", "3094-0", "2160-0", "2345-7", "2075-0", "2028-9", "6768-6", "1751-7")
OWNERS = (
    (("85556-9",), "Clinical Informatics / Data Steward", "Check capture and mapping of the acuity index at both ends of the window."),
    (ASSESSMENT_CODES, "Nurse Supervisor / Quality Lead", "Make the assessment part of the shift workflow and audit its completion."),
    (VITAL_CODES, "Biomedical Engineering / Clinical Informatics", "Audit monitor connectivity and the mapping of vital signs."),
    (LAB_CODES, "Lab IT / Clinical Informatics", "Audit the laboratory feed, analyte mapping and result delay."),
)
ELIGIBILITY_OWNER = ("Data Engineer / Epidemiology", "Rewrite the rule as a structured expression or compute it upstream.")


def playbook_severity(excluded: Column, n_before: Column) -> Column:
    share = F.when(n_before > 0, excluded / n_before)
    return (
        F.when(F.coalesce(n_before, F.lit(0)) <= 0, F.lit("low"))
        .when((excluded >= 50) | (share >= 0.25), F.lit("critical"))
        .when((excluded >= 10) | (share >= 0.10), F.lit("high"))
        .when((excluded >= 3) | (share >= 0.03), F.lit("medium"))
        .otherwise(F.lit("low"))
    )


def quality_playbook(reasons: DataFrame, stages: DataFrame, *, n_before: Column | int, top: int | None = None) -> DataFrame:
    """Ranked issues with severity, owner and action, from missingness reasons and failed criteria."""
    n = n_before if isinstance(n_before, Column) else F.lit(n_before)
    owner, action = F.lit("Quality Ops"), F.lit("Review capture at the source, mapping and training for the missing value.")
    for codes, who, what in reversed(OWNERS):
        hit = F.col("code").isin(list(codes))
        owner, action = F.when(hit, F.lit(who)).otherwise(owner), F.when(hit, F.lit(what)).otherwise(action)
    missing = _top(reasons.filter((F.col("code") != "") & (F.col("excluded") > 0)).orderBy(F.col("excluded").desc(), "code", "where"), top)
    first = missing.select(
        F.lit("missingness").alias("stage"), "code", "display", "where", "excluded", playbook_severity(F.col("excluded"), n).alias("severity"), owner.alias("owner_role"), action.alias("action")
    )
    second = stages.filter(F.col("error").isNotNull()).select(
        F.concat(F.lit("eligibility_stage_"), "stage").alias("stage"),
        F.lit("eligibility_expression").alias("code"),
        F.col("description").alias("display"),
        F.lit("").alias("where"),
        "excluded",
        F.lit("medium").alias("severity"),
        F.lit(ELIGIBILITY_OWNER[0]).alias("owner_role"),
        F.lit(ELIGIBILITY_OWNER[1]).alias("action"),
    )
    rank = F.when(F.col("severity") == "critical", 0).when(F.col("severity") == "high", 1).when(F.col("severity") == "medium", 2).otherwise(3)
    return first.unionByName(second).orderBy(rank, F.col("excluded").desc(), "code", "where")


# --- flow and report -------------------------------------------------------------------------


def consort_flow(df: DataFrame, criteria: Sequence[dict], *, required: Sequence[str]) -> DataFrame:
    """One row: assessed, eligible, excluded by filters, excluded by missingness, included, unit hint."""
    eligible, _ = eligibility_filter(df, criteria)
    gone = is_excluded(gating_flags(df.columns, required))
    head = df.agg(F.count(F.lit(1)).alias("assessed"))
    tail = eligible.agg(F.count(F.lit(1)).alias("eligible"), F.count_if(~gone).alias("included"))
    row = stat_columns(head, tail)
    if "unit_id" in df.columns:
        per_unit = df.filter(F.col("unit_id").isNotNull()).groupBy("unit_id").agg(F.count(F.lit(1)).alias("n"))
        hint = per_unit.agg(F.min_by("unit_id", F.struct((-F.col("n")).alias("n"), F.col("unit_id"))).alias("u"))
        row = row.withColumn("unit_hint", hint.scalar().cast("string"))
    else:
        row = row.withColumn("unit_hint", F.lit(None).cast("string"))
    return row.select(
        "assessed",
        "eligible",
        (F.col("assessed") - F.col("eligible")).alias("excluded_eligibility"),
        (F.col("eligible") - F.col("included")).alias("excluded_missingness"),
        "included",
        "unit_hint",
    )


def trial_report(df: DataFrame, criteria: Sequence[dict], *, treatment: str, outcome: str, required: Sequence[str], closing: DataFrame) -> DataFrame:
    """One row: flow, reasons, playbook and closing metrics as JSON with a content hash."""
    eligible, stages = eligibility_filter(df, criteria)
    _, reasons = missingness_exclusions(eligible, required=required)
    flow = consort_flow(df, criteria, required=required)
    listed = lambda d: d.agg(F.array_sort(F.collect_list(F.struct(*sorted(d.columns)))).alias("a"))
    plan = quality_playbook(reasons, stages, n_before=flow.select("eligible").scalar())
    row = stat_columns(flow, closing).withColumns(
        {"stages": listed(stages).scalar(), "reasons": listed(reasons).scalar(), "playbook": listed(plan).scalar()}
    )
    body = row.withColumn("treatment", F.lit(treatment)).withColumn("outcome", F.lit(outcome))
    text = body.select("*", F.to_json(F.struct(*sorted(body.columns))).alias("report"))
    return text.select("assessed", "eligible", "included", "report", F.sha2("report", 256).alias("report_hash"))


# --- federation ------------------------------------------------------------------------------


def federated_weights(updates: DataFrame) -> DataFrame:
    """Accepted client updates with weight n_rows / total of the round (a total of 0 counts as 1)."""
    live = updates.filter("accepted")
    totals = live.groupBy("round_id").agg(F.sum(F.coalesce("n_rows", F.lit(0))).alias("total_rows"))
    joined = live.join(totals, "round_id")
    weight = F.coalesce("n_rows", F.lit(0)) / F.when(F.col("total_rows") == 0, F.lit(1)).otherwise(F.col("total_rows"))
    return joined.withColumn("weight", weight)


def ensemble_prediction(predictions: DataFrame, weights: DataFrame, *, row_id: str) -> DataFrame:
    """Weighted sum of the member predictions (row_id, client_id, prediction) of a round."""
    w = weights.select("round_id", "client_id", "weight")
    return predictions.join(w, ["round_id", "client_id"]).groupBy("round_id", row_id).agg(F.sum(F.col("weight") * F.col("prediction")).alias("prediction"))
