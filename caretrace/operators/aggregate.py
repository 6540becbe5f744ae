"""Governed aggregation under small-cell suppression."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caretrace import constants as C
from caretrace.functions.columns import compact, or_default, string_array, tag_if
from caretrace.functions.quantiles import weighted_quantiles
from caretrace.functions.tables import distinct_values_per_key

BAND = ((0.10, "p10"), (0.50, "p50"), (0.90, "p90"))
SCORE_CELL = 0.05  # scores span 0..100, so a group has at most 2000 cells
STATUSES = ("provisional", "insufficient_evidence", "contract_mismatch", "low_feature_coverage", "shadow_only")


def _date(c: str) -> Column:
    """Local calendar date of an ISO text, offset kept as written."""
    day = F.substring(F.col(c).cast("string"), 1, 10)
    return F.when(day.try_cast("date").isNotNull() & day.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), day)


def group_key(columns: Sequence[str], group_by: str) -> Column:
    text = lambda c: F.nullif(F.col(c).cast("string"), F.lit("")) if c in columns else F.lit(None).cast("string")
    days = [_date(c) for c in ("start_dt", "end_dt") if c in columns]
    day = F.coalesce(*days, F.lit("unknown"))
    unit = F.coalesce(F.col("unit_id").cast("string"), F.lit("None"))
    if group_by in ("episode", "patient"):
        return F.coalesce(text("patient_key"), text("episode_id"), text("row_id"))
    if group_by == "window":
        return F.coalesce(text("window_id"), text("row_id"))
    if group_by == "unit":
        return unit
    if group_by == "date":
        return day
    if group_by == "shift":
        return F.concat(F.lit("unit:"), unit, F.lit("|date:"), day)
    return text("row_id")


def safe_grouping(requested: str, *, grain: str) -> tuple[str, list[str], bool]:
    """(effective grouping, warnings, staff support needed): groupings that single people out become unit."""
    requested = str(requested or "unit")
    if requested in ("patient", "episode", "window", "nurse"):
        return "unit", [f"{requested}_grouping_individualizable_falling_back_to_unit"], False
    if requested == "team":
        return "unit", ["team_not_explicitly_modeled_falling_back_to_unit"], False
    if requested == "shift":
        if grain != "window":
            return "unit", ["shift_aggregation_requires_window_grain_falling_back_to_unit"], False
        return "shift", ["shift_aggregation_deidentified_to_unit_date_bucket"], True
    if requested not in ("unit", "date"):
        return "unit", ["unsupported_grouping_falling_back_to_unit"], False
    return requested, [], False


def row_weight() -> Column:
    """severity * exposure, each defaulting to 1 when absent or 0, never negative."""
    return F.greatest(or_default("severity_weight", 1.0) * or_default("exposure_share", 1.0), F.lit(0.0))


def prepare(rows: DataFrame, group_by: str) -> DataFrame:
    """Rows with ``group``, ``_w`` and ``_on`` (the row carries a score that counts)."""
    counts = F.col("score").isNotNull() & F.coalesce(F.col("status").isin(list(C.SCORED_STATUSES)), F.lit(False))
    return rows.withColumn("group", group_key(rows.columns, group_by)).withColumn("_w", row_weight()).withColumn("_on", counts)


def weighted_score_aggs(epsilon: float = C.EPS) -> list[Column]:
    """Weighted score and the moments for its standard deviation in one pass."""
    on = F.col("_on")
    return [
        F.sum(F.when(on, F.col("score") * F.col("_w"))).alias("_sx"),
        F.sum(F.when(on, F.col("_w"))).alias("_sw"),
        F.count_if(on).alias("_n_scored"),
    ]


def weighted_score(rows: DataFrame, *, group_by: str, epsilon: float = C.EPS) -> DataFrame:
    g = prepare(rows, group_by).groupBy("group").agg(*weighted_score_aggs(epsilon))
    return g.select("group", F.when(F.col("_sw") > 0, F.col("_sx") / (F.col("_sw") + epsilon)).alias("score"), F.coalesce("_sw", F.lit(0.0)).alias("total_weight"))


def component_means(rows: DataFrame, *, group_by: str) -> DataFrame:
    """(group, component, mean): weighted mean per component over counting rows."""
    long = prepare(rows, group_by).filter("_on").select("group", "_w", F.explode("components").alias("component", "_v"))
    sums = long.filter(F.col("_v").isNotNull()).groupBy("group", "component").agg(
        F.sum(F.col("_v") * F.col("_w")).alias("_s"), F.sum("_w").alias("_d")
    )
    return sums.select("group", "component", F.when(F.col("_d") > 0, F.col("_s") / F.col("_d")).alias("mean"))


def weighted_quantile(rows: DataFrame, *, group_by: str) -> DataFrame:
    """(group, p10, p50, p90) of the scores."""
    on = prepare(rows, group_by).filter("_on").select("group", "score", "_w")
    return weighted_quantiles(
        on, key="group", value="score", weight="_w", probs=[q for q, _ in BAND], names=[n for _, n in BAND], cell=SCORE_CELL
    )


def weighted_std(rows: DataFrame, *, group_by: str) -> DataFrame:
    """Two passes: the weighted mean of the group, then the weighted squared deviation from it."""
    on = prepare(rows, group_by).filter("_on").select("group", "score", "_w")
    means = on.groupBy("group").agg((F.sum(F.col("score") * F.col("_w")) / F.nullif(F.sum("_w"), F.lit(0.0))).alias("_mu"))
    dev = on.join(means, "group").groupBy("group").agg(
        F.sum(F.col("_w") * F.pow(F.col("score") - F.col("_mu"), 2)).alias("_s"), F.sum("_w").alias("_d")
    )
    return dev.select("group", F.when(F.col("_d") > 0, F.sqrt(F.col("_s") / F.col("_d"))).alias("weighted_std"))


def _status_aggs() -> list[Column]:
    s = F.col("status")
    return [
        F.count(F.lit(1)).alias("n_observations"),
        F.count_if(F.coalesce(s.isin(list(C.SCORED_STATUSES)), F.lit(False))).alias("n_scored_aggregate"),
        *[F.count_if(s == x).alias(f"n_{x}") for x in STATUSES],
    ]


def _fractions() -> dict[str, Column]:
    n = F.col("n_observations")
    return {
        "coverage": F.col("_n_scored") / n,
        "provisional_fraction": F.col("n_provisional") / n,
        "complete_fraction": F.col("n_scored_aggregate") / n,
        "insufficient_fraction": F.col("n_insufficient_evidence") / n,
    }


def status_profile(rows: DataFrame, *, group_by: str) -> DataFrame:
    g = prepare(rows, group_by).groupBy("group").agg(*_status_aggs(), F.count_if("_on").alias("_n_scored"))
    return g.withColumns(_fractions()).drop("_n_scored")


def support_counts(rows: DataFrame, *, group_by: str) -> DataFrame:
    """(group, n_observations, n_episodes, n_staff).

    Distinct members are deduplicated per (group, member) first, so a hot group is spread by member.
    """
    p = prepare(rows, group_by)
    total = p.groupBy("group").agg(F.count(F.lit(1)).alias("n_observations"))
    episodes = (
        p.filter(F.col("episode_id").isNotNull() & (F.col("episode_id").cast("string") != ""))
        .select("group", F.col("episode_id").cast("string").alias("_e"))
        .distinct()
        .groupBy("group")
        .agg(F.count(F.lit(1)).alias("n_episodes"))
    )
    staff = (
        p.select("group", F.explode(F.map_keys("staff_shares")).alias("_s"))
        .filter(F.col("_s") != "")
        .distinct()
        .groupBy("group")
        .agg(F.count(F.lit(1)).alias("n_staff"))
    )
    out = total.join(episodes, "group", "left").join(staff, "group", "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in ("n_episodes", "n_staff")})


def suppression_reasons(*, min_cell: int = C.MIN_CELL, min_staff: int = C.MIN_STAFF, need_staff: bool = False) -> Column:
    return compact(
        tag_if(F.col("n_observations") < min_cell, "n_observations_below_min_cell_count"),
        tag_if(F.col("n_episodes") < min_cell, "n_episodes_below_min_cell_count"),
        tag_if(F.lit(need_staff) & (F.col("n_staff") < min_staff), "n_staff_below_min_staff_count"),
    )


def suppress_low_support(cells: DataFrame, numbers: Sequence[str], **limits) -> DataFrame:
    """Numbers of thin cells become NULL; adds suppressed and suppression_reasons."""
    out = cells.withColumn("suppression_reasons", suppression_reasons(**limits)).withColumn("suppressed", F.size("suppression_reasons") > 0)
    return out.withColumns({c: F.when(~F.col("suppressed"), F.col(c)) for c in numbers})


def aggregate_scores(
    rows: DataFrame,
    *,
    group_by: str,
    epsilon: float = C.EPS,
    need_staff: bool = False,
    case_mix_warnings: Sequence[str] = (),
    enforce: bool = True,
    min_cell: int = C.MIN_CELL,
    min_staff: int = C.MIN_STAFF,
) -> DataFrame:
    """Governed cells: score, band, component means, support, fractions, warnings."""
    p = prepare(rows, group_by)
    base = p.groupBy("group").agg(*_status_aggs(), *weighted_score_aggs(epsilon)).withColumns(_fractions())
    means = component_means(rows, group_by=group_by).groupBy("group").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("component", "mean")))).alias("component_means")
    )
    support = support_counts(rows, group_by=group_by).select("group", "n_episodes", "n_staff")
    notes = distinct_values_per_key(p, ["group"], "warnings", "_notes")
    cells = (
        base.join(support, "group", "left")
        .join(weighted_quantile(rows, group_by=group_by), "group", "left")
        .join(weighted_std(rows, group_by=group_by), "group", "left")
        .join(means, "group", "left")
        .join(notes, "group", "left")
        .withColumn("score", F.when(F.col("_sw") > 0, F.col("_sx") / (F.col("_sw") + epsilon)))
    )
    limits = {"min_cell": min_cell, "min_staff": min_staff, "need_staff": need_staff} if enforce else {"min_cell": 0, "min_staff": 0}
    numbers = ["score", "p10", "p50", "p90", "weighted_std", "component_means"]
    cut = suppress_low_support(cells, numbers, **limits)
    extra = list(case_mix_warnings) + ["no_comparable_without_case_mix"] if case_mix_warnings and group_by in ("unit", "date", "shift") else []
    empty = F.array().cast("array<string>")
    warnings = F.concat(
        F.coalesce("_notes", empty),
        string_array(extra),
        F.when(F.col("suppressed"), F.concat(F.col("suppression_reasons"), string_array(["suppressed_low_support"]))).otherwise(empty),
    )
    return (
        cut.withColumn("warnings", F.array_sort(F.array_distinct(warnings)))
        .withColumn(
            "status",
            F.when(F.col("suppressed"), F.lit("suppressed_low_support")).when(F.col("score").isNotNull(), F.lit("scored_aggregate")).otherwise(F.lit("insufficient_evidence")),
        )
        .withColumn("n_suppressed_low_support", F.when(F.col("suppressed"), F.col("n_observations")).otherwise(F.lit(0)))
        .drop("_sx", "_sw", "_n_scored", "_notes")
        .orderBy("group")
    )


def governance_columns(
    cells: DataFrame, *, level: str, formula_version: str, model_id: str, min_cell: int = C.MIN_CELL
) -> DataFrame:
    """Export metadata beside every cell; ``summary_redacted`` when any cell is suppressed."""
    hidden = cells.agg(F.count_if("suppressed").alias("n"))
    return cells.withColumn("suppressed_cells", hidden.scalar()).withColumns(
        {
            "non_individual_use": F.lit(True),
            "shadow_mode": F.lit(True),
            "aggregation_level": F.lit(level),
            "min_cell_count": F.lit(min_cell),
            "formula_version": F.lit(formula_version),
            "model_id": F.lit(model_id),
            "summary_redacted": F.col("suppressed_cells") > 0,
        }
    )


def writeback_list(records: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Per defensible model: counts under support rules; records of other models counted as blocked.

    ``artifacts`` has model_id and defensible.
    """
    counts = records.groupBy("model_id").agg(
        F.count(F.lit(1)).alias("count"), F.count_if("attempted").alias("attempted"), F.count_if("ok").alias("ok")
    )
    judged = counts.join(artifacts.select("model_id", "defensible"), "model_id", "left").withColumn(
        "defensible", F.coalesce("defensible", F.lit(False))
    )
    blocked = judged.agg(F.coalesce(F.sum(F.when(~F.col("defensible"), F.col("count"))), F.lit(0)).alias("n"))
    thin = F.col("count") < C.MIN_CELL
    safe = lambda c: F.when(~thin, support_safe(F.col(c)))
    return judged.filter("defensible").select(
        "model_id",
        F.when(~thin, F.col("count")).alias("count"),
        safe("attempted").alias("attempted"),
        safe("ok").alias("ok"),
        thin.alias("suppressed"),
        F.when(thin, F.lit("suppressed_low_support")).otherwise(F.lit("aggregate_only")).alias("status"),
    ).withColumn("blocked_model_records", support_safe(blocked.scalar()))


def support_safe(n: Column) -> Column:
    """NULL for counts that are positive but below the cell minimum."""
    return F.when(~((n > 0) & (n < C.MIN_CELL)), n)


def dashboard_counts(tables: dict[str, DataFrame], *, open_counts: Sequence[str] = ("audit_events", "governance_decisions")) -> DataFrame:
    """(name, n) per table; small counts are hidden except for ``open_counts``."""
    parts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n") for name, df in tables.items()]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    return union.withColumn("n", F.when(F.col("name").isin(list(open_counts)), F.col("n")).otherwise(support_safe(F.col("n"))))


def latest_row(df: DataFrame, columns: Sequence[str], order: Sequence[str]) -> DataFrame:
    picked = df.agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("_r"))
    return picked.select(*[F.col(f"_r.{c}").alias(c) for c in columns])


def roster_summary(shifts: DataFrame) -> DataFrame:
    return shifts.agg(F.count(F.lit(1)).alias("roster_shifts"), F.count_distinct("unit_id").alias("units_with_roster"))


def economic_projection(
    cells: DataFrame, *, delta: str = "delta", elasticity: float = -0.12, cost_per_bed_day: float = 900.0, extra_cost: float = 0.0
) -> DataFrame:
    """Stay, savings and net savings per cell from a score change."""
    stay = F.lit(elasticity) * F.col(delta)
    return cells.withColumn("delta_los_days", stay).withColumn("bed_day_savings", -F.col("delta_los_days") * F.lit(cost_per_bed_day)).withColumn(
        "net_savings", F.col("bed_day_savings") - F.lit(extra_cost)
    )
