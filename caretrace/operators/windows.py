"""Episode and window features: interval joins, last values, nearest-boundary outcomes.

Table shapes (UTC wall-clock timestamps, type TIMESTAMP_NTZ):

* episodes: episode_id, unit_id, admission, discharge (NULL = open), ri_initial, ri_final
* windows: episode_id, window_index, start_dt, end_dt plus the episode columns
* procedures: episode_id, performed_dt, performer_role, performer_actor_ref, is_nursing
* observations: obs_id, episode_id, code_system, code, display, value_num, effective_dt
* shifts: shift_id, unit_id, start_dt, end_dt, rn_count, na_count, patient_census (NULL = unknown)
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caretrace import constants as C
from caretrace.functions.columns import (
    compact,
    guarded_ratio,
    hours_between,
    micros,
    plus_hours,
    plus_minutes,
    string_array,
    tag_if,
)
from caretrace.functions.intervals import asof_bounds, overlapping_intervals, points_in_intervals, running_counts

WINDOW_KEYS = ["episode_id", "window_index"]


def ntz(value: datetime | str) -> Column:
    return F.lit(str(value)).cast("timestamp_ntz")


# --- specs and windows -----------------------------------------------------------------------


def episode_temporal_spec(
    episodes: DataFrame, *, as_of: datetime | str, feature_hours: int = 24, outcome_hours: int = 24
) -> DataFrame:
    """Episode rows with the eight specification fields; the outcome is marked as the legacy one."""
    feature_end = F.least(plus_hours("admission", feature_hours), F.coalesce("discharge", ntz(as_of)))
    return (
        episodes.withColumn("temporal_spec_version", F.lit(C.TEMPORAL_SPEC_VERSION))
        .withColumn("index_time", F.col("admission"))
        .withColumn("feature_window_start", F.col("admission"))
        .withColumn("feature_window_end", feature_end)
        .withColumn("outcome_window_start", F.col("feature_window_end"))
        .withColumn("outcome_window_end", plus_hours("feature_window_end", outcome_hours))
        .withColumn("censoring_reason", F.lit("legacy_discharge_endpoint"))
        .withColumn("outcome_status", F.lit(C.STATUS_LEGACY))
    )


def fixed_windows(episodes: DataFrame, *, window_hours: int, as_of: datetime | str) -> DataFrame:
    """Consecutive windows from admission; the last one is cut at discharge (or ``as_of``)."""
    if not 1 <= int(window_hours) <= 168:
        raise ValueError("window_hours must be within 1..168")
    last = F.coalesce("discharge", ntz(as_of))
    step = F.expr(f"INTERVAL '{int(window_hours)}' HOUR")
    starts = F.sequence(F.col("admission"), F.col("_end") - F.expr("INTERVAL '0.000001' SECOND"), step)
    return (
        episodes.withColumn("_end", last)
        .filter(F.col("_end") > F.col("admission"))
        .select("*", F.posexplode(starts).alias("window_index", "start_dt"))
        .withColumn("end_dt", F.least(F.col("start_dt") + step, F.col("_end")))
        .drop("_end")
    )


def shift_windows(episodes: DataFrame, shifts: DataFrame, *, window_hours: int, as_of: datetime | str) -> DataFrame:
    """Unit shifts cut to the episode; episodes without any overlapping shift get fixed windows."""
    live = episodes.withColumn("_end", F.coalesce("discharge", ntz(as_of))).filter(F.col("_end") > F.col("admission"))
    s = shifts.select("unit_id", "shift_id", F.col("start_dt").alias("_ss"), F.col("end_dt").alias("_se"))
    pairs = overlapping_intervals(
        live, s, key="unit_id", left_start="admission", left_end="_end", right_start="_ss", right_end="_se"
    )
    cut = (
        pairs.withColumn("start_dt", F.greatest("_ss", "admission"))
        .withColumn("end_dt", F.least("_se", "_end"))
        .filter(F.col("end_dt") > F.col("start_dt"))
    )
    order = Window.partitionBy("episode_id").orderBy("_ss", "shift_id")
    by_shift = cut.withColumn("window_index", F.row_number().over(order) - 1)
    columns = [*episodes.columns, "window_index", "start_dt", "end_dt"]
    uncovered = episodes.join(by_shift.select("episode_id").distinct(), "episode_id", "left_anti")
    fallback = fixed_windows(uncovered, window_hours=window_hours, as_of=as_of)
    return by_shift.select(*columns).unionByName(fallback.select(*columns))


def window_temporal_spec(windows: DataFrame, *, follow_up_hours: int) -> DataFrame:
    wanted = plus_hours("end_dt", follow_up_hours)
    is_open = F.col("discharge").isNull()
    early = F.col("discharge") < wanted
    return (
        windows.withColumn("temporal_spec_version", F.lit(C.TEMPORAL_SPEC_VERSION))
        .withColumn("index_time", F.col("start_dt"))
        .withColumn("feature_window_start", F.col("start_dt"))
        .withColumn("feature_window_end", F.col("end_dt"))
        .withColumn("outcome_window_start", F.col("end_dt"))
        .withColumn("outcome_window_end", F.when(is_open, F.lit(None)).when(early, F.col("discharge")).otherwise(wanted))
        .withColumn(
            "censoring_reason",
            F.when(is_open, F.lit("open_episode_outcome_window_unobserved"))
            .when(early, F.lit("discharged_before_outcome_window_end"))
            .otherwise(F.lit("not_censored")),
        )
    )


# --- procedures and vitals -------------------------------------------------------------------


def _procedure_aggs(role_pattern: str) -> list[Column]:
    role = F.coalesce(F.col("performer_role"), F.lit(""))
    return [
        F.count(F.col("performed_dt")).alias("proc_count"),
        F.count_if(F.col("performed_dt").isNotNull() & role.rlike("(?i)" + role_pattern)).alias("nurse_proc_count"),
        F.count_if(F.col("performed_dt").isNotNull() & F.col("is_nursing")).alias("nurse_proc_count_det"),
    ]


COUNT_COLS = ["proc_count", "nurse_proc_count", "nurse_proc_count_det"]
PROC_COLS = ["episode_id", "performed_dt", "performer_role", "is_nursing"]


def _zero_fill(df: DataFrame, cols: list[str], kind: str = "long") -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(0)).cast(kind) for c in cols})


def procedure_counts(
    grains: DataFrame, procedures: DataFrame, *, grain: str, role_pattern: str = C.NURSE_ROLE_PATTERN
) -> DataFrame:
    """Counts per episode (everything up to ``feature_window_end``) or per window (``[start, end)``)."""
    p = procedures.select(*PROC_COLS)
    if grain == "episode":
        ids = ["episode_id"]
        hit = p.join(grains.select("episode_id", "feature_window_end"), "episode_id").filter(
            F.col("performed_dt") <= F.col("feature_window_end")
        )
    else:
        ids = WINDOW_KEYS
        hit = points_in_intervals(
            p, grains.select(*ids, "start_dt", "end_dt"), key="episode_id", ts="performed_dt", start="start_dt", end="end_dt"
        )
    counted = hit.groupBy(*ids).agg(*_procedure_aggs(role_pattern))
    return _zero_fill(grains.select(*ids).join(counted, ids, "left"), COUNT_COLS)


def _loinc(obs: DataFrame) -> DataFrame:
    return obs.filter(F.lower("code_system").contains("loinc") & F.col("value_num").isNotNull())


def _last_vital(code: str) -> Column:
    hit = F.col("code") == code
    return F.max_by(F.when(hit, F.col("value_num")), F.when(hit, F.struct("effective_dt", "obs_id"))).alias(
        f"_last_{C.VITALS[code]}"
    )


def _vital_columns(df: DataFrame) -> DataFrame:
    cols: dict[str, Column] = {}
    for code, short in C.VITALS.items():
        last = F.col(f"_last_{short}")
        flag = last.isNull().cast("long")
        cols[f"vs_{short}_last"] = F.coalesce(last, F.lit(0.0))
        cols[f"missing_vs_{short}_last"] = flag
        cols[f"missing_loinc_{code.replace('-', '_')}"] = flag
    return df.withColumns(cols).drop(*[f"_last_{s}" for s in C.VITALS.values()])


VITAL_COLS = [
    c
    for code, s in C.VITALS.items()
    for c in (f"vs_{s}_last", f"missing_vs_{s}_last", f"missing_loinc_{code.replace('-', '_')}")
]


def _vital_rows(obs: DataFrame) -> DataFrame:
    return _loinc(obs).filter(F.col("code").isin(list(C.VITALS))).select(
        "episode_id", "code", "value_num", "effective_dt", "obs_id"
    )


def vitals_last(grains: DataFrame, observations: DataFrame, *, grain: str) -> DataFrame:
    """Latest value per vital code with missing flags; absent values are 0."""
    rows = _vital_rows(observations)
    if grain == "episode":
        ids = ["episode_id"]
        hit = rows.join(grains.select("episode_id", "feature_window_end"), "episode_id").filter(
            F.col("effective_dt") <= F.col("feature_window_end")
        )
    else:
        ids = WINDOW_KEYS
        hit = points_in_intervals(
            rows, grains.select(*ids, "start_dt", "end_dt"), key="episode_id", ts="effective_dt", start="start_dt", end="end_dt"
        )
    last = hit.groupBy(*ids).agg(*[_last_vital(c) for c in C.VITALS])
    return _vital_columns(grains.select(*ids).join(last, ids, "left"))


def window_signals(
    windows: DataFrame, procedures: DataFrame, observations: DataFrame, *, role_pattern: str = C.NURSE_ROLE_PATTERN
) -> DataFrame:
    """Procedure counts and last vitals of every window in one interval join and one aggregate."""
    p = procedures.select(*PROC_COLS).withColumn("_ts", F.col("performed_dt"))
    v = _vital_rows(observations).withColumn("_ts", F.col("effective_dt"))
    signals = p.unionByName(v, allowMissingColumns=True)
    hit = points_in_intervals(
        signals,
        windows.select(*WINDOW_KEYS, "start_dt", "end_dt"),
        key="episode_id",
        ts="_ts",
        start="start_dt",
        end="end_dt",
    )
    return hit.groupBy(*WINDOW_KEYS).agg(*_procedure_aggs(role_pattern), *[_last_vital(c) for c in C.VITALS])


# --- roster ----------------------------------------------------------------------------------


def roster_overlap(grains: DataFrame, shifts: DataFrame, *, ids: list[str], start: str, end: str) -> DataFrame:
    """Shift x grain pairs of one unit with a positive overlap, cut to the grain."""
    g = grains.select(*ids, "unit_id", F.col(start).alias("_gs"), F.col(end).alias("_ge"))
    s = shifts.select(
        "unit_id", "shift_id", F.col("start_dt").alias("_ss"), F.col("end_dt").alias("_se"), "rn_count", "na_count", "patient_census"
    )
    pairs = overlapping_intervals(g, s, key="unit_id", left_start="_gs", left_end="_ge", right_start="_ss", right_end="_se")
    return (
        pairs.withColumn("overlap_start", F.greatest("_ss", "_gs"))
        .withColumn("overlap_end", F.least("_se", "_ge"))
        .withColumn("overlap_hours", F.greatest(hours_between("overlap_start", "overlap_end"), F.lit(0.0)))
        .filter(F.col("overlap_hours") > 0)
        .select(*ids, "unit_id", "shift_id", "overlap_start", "overlap_end", "overlap_hours", "rn_count", "na_count", "patient_census")
    )


def census_fallback(overlaps: DataFrame, episodes: DataFrame) -> DataFrame:
    """Known census, else episodes of the unit present at any time in the closed overlap; at least 1."""
    unknown = overlaps.filter(F.col("patient_census").isNull())
    started = F.coalesce(F.col("discharge") >= F.col("admission"), F.lit(True))
    counts = running_counts(
        unknown,
        key="unit_id",
        opened=episodes.filter(started).select("unit_id", F.col("admission").alias("t")),
        closed=episodes.filter(F.col("discharge") >= F.col("admission")).select("unit_id", F.col("discharge").alias("t")),
        lower="overlap_start",
        upper="overlap_end",
    )
    # Records whose discharge precedes admission count only when both ends fall inside the overlap.
    inverted = episodes.filter(F.col("discharge") < F.col("admission")).select("unit_id", "admission", "discharge")
    spans = ["unit_id", "overlap_start", "overlap_end"]
    odd = (
        points_in_intervals(
            inverted, unknown.select(*spans).distinct(), key="unit_id", ts="discharge", start="overlap_start", end="overlap_end", closed_end=True
        )
        .filter(F.col("admission") <= F.col("overlap_end"))
        .groupBy(*spans)
        .agg(F.count(F.lit(1)).alias("_odd"))
    )
    present = F.coalesce("n", F.lit(0)) + F.coalesce("_odd", F.lit(0))
    return (
        overlaps.join(counts, spans, "left")
        .join(odd, spans, "left")
        .withColumn("census", F.greatest(F.coalesce(F.col("patient_census").cast("long"), present), F.lit(1)))
        .drop("n", "_odd")
    )


def staffing_exposure(grains: DataFrame, overlaps: DataFrame, *, ids: list[str]) -> DataFrame:
    """Nurse hours per patient day and skill mix; 0 without shifts or with an empty denominator."""
    staff = F.greatest(F.col("rn_count") + F.col("na_count"), F.lit(0)).cast("double")
    rn = F.greatest(F.col("rn_count"), F.lit(0)).cast("double")
    sums = overlaps.groupBy(*ids).agg(
        F.sum(staff * F.col("overlap_hours")).alias("nurse_hours"),
        F.sum(rn * F.col("overlap_hours")).alias("rn_hours"),
        F.sum(F.col("census") * F.col("overlap_hours")).alias("patient_hours"),
    )
    hours = ["nurse_hours", "rn_hours", "patient_hours"]
    filled = _zero_fill(grains.select(*ids).join(sums, ids, "left"), hours, "double")
    return filled.withColumn(
        "nurse_hppd", guarded_ratio(F.col("nurse_hours"), F.col("patient_hours") / F.lit(24.0))
    ).withColumn("nurse_skillmix", guarded_ratio(F.col("rn_hours"), F.col("nurse_hours")))


# --- acuity series and outcomes --------------------------------------------------------------


def ri_series(observations: DataFrame, *, variant: str = "window", codes: tuple[str, ...] = (C.ACUITY_CODE,)) -> DataFrame:
    """Acuity points (episode_id, effective_dt, obs_id, value_num).

    ``window`` looks only at LOINC systems and accepts the short code forms; ``causal`` looks at every
    system and accepts the code list, the display text and the code ``ri``.
    """
    obs = observations.filter(F.col("value_num").isNotNull() & F.col("effective_dt").isNotNull())
    shown = F.coalesce(F.lower("display").contains("rothman"), F.lit(False))
    code = F.coalesce(F.trim("code"), F.lit("")) if variant == "window" else F.coalesce(F.col("code"), F.lit(""))
    if variant == "window":
        obs = obs.filter(F.lower("code_system").contains("loinc"))
        hit = code.isin(list(codes)) | shown | F.lower(code).isin("rothman", "ri")
    else:
        hit = code.isin(list(codes)) | shown | (F.lower(code) == "ri") if codes else F.lit(True)
    return obs.filter(hit).select("episode_id", "effective_dt", "obs_id", F.col("value_num").cast("double").alias("value_num"))


def _anchors(windows: DataFrame, named: dict[str, Column]) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(n).alias("which"), c.alias("at")) for n, c in named.items()])
    return windows.select("episode_id", "window_index", F.inline(rows))


def _lookup(windows: DataFrame, series: DataFrame, named: dict[str, Column]) -> DataFrame:
    """One row per window with ``<name>_prev`` / ``<name>_next`` points of each named anchor."""
    found = asof_bounds(
        _anchors(windows, named),
        series,
        keys=["episode_id"],
        anchor_ts="at",
        point_ts="effective_dt",
        point_cols=["obs_id", "value_num"],
    )
    picks = [
        F.max(F.when(F.col("which") == n, F.col(side))).alias(f"{n}_{side}") for n in named for side in ("prev", "next")
    ]
    return found.groupBy("episode_id", "window_index").agg(*picks)


def _nearest(prev: Column, nxt: Column, at: Column, low: Column | None, high: Column | None, tol_minutes: int) -> Column:
    """Value of the nearer of two points inside [low, high] and within the tolerance (0 = unlimited)."""

    def usable(p: Column) -> Column:
        ok = p.isNotNull()
        if low is not None:
            ok = ok & (p["ts"] >= low) & (p["ts"] <= high)
        return F.when(ok, F.struct(F.abs(micros(p["ts"]) - micros(at)).alias("d"), p["ts"].alias("ts"), p["value_num"].alias("v")))

    best = F.least(usable(prev), usable(nxt))
    if tol_minutes > 0:
        return F.when(best["d"] <= tol_minutes * 60_000_000, best["v"])
    return best["v"]


def _two_points(first: Column, last: Column, low: Column, high: Column) -> Column:
    """At least two points in [low, high], given its first and last candidates."""
    return F.coalesce(
        (first["ts"] <= high) & (last["ts"] >= low) & (first != last) & (first["ts"] >= low) & (last["ts"] <= high), F.lit(False)
    )


def outcome_bounds(windows: DataFrame, series: DataFrame, *, boundary: str = "first_last", tol_minutes: int = 60) -> DataFrame:
    """``ri_start`` / ``ri_end`` per window over its closed outcome range (needs two points there).

    Read off as-of lookups at the range ends, so a long follow-up over short windows does not multiply
    the observation rows.
    """
    os_, oe = F.col("outcome_window_start"), F.col("outcome_window_end")
    if boundary == "nearest":
        low, high = plus_minutes(os_, -tol_minutes), plus_minutes(oe, tol_minutes)
        named = {"lo": low, "hi": high, "t0": os_, "t1": oe}
    else:
        low, high = os_, oe
        named = {"t0": os_, "t1": oe}
    looked = _lookup(windows, series, named)
    joined = windows.join(looked, WINDOW_KEYS, "left")
    if boundary == "nearest":
        enough = _two_points(F.col("lo_next"), F.col("hi_prev"), low, high)
        start = _nearest(F.col("t0_prev"), F.col("t0_next"), os_, low, high, tol_minutes)
        end = _nearest(F.col("t1_prev"), F.col("t1_next"), oe, low, high, tol_minutes)
    else:
        enough = _two_points(F.col("t0_next"), F.col("t1_prev"), low, high)
        start, end = F.col("t0_next.value_num"), F.col("t1_prev.value_num")
    drop = [f"{n}_{s}" for n in named for s in ("prev", "next")]
    return joined.withColumn("ri_start", F.when(enough, start)).withColumn("ri_end", F.when(enough, end)).drop(*drop)


def outcome_first_last(windows: DataFrame, series: DataFrame) -> DataFrame:
    return outcome_bounds(windows, series, boundary="first_last")


def outcome_nearest(windows: DataFrame, series: DataFrame, *, tol_minutes: int = 60) -> DataFrame:
    return outcome_bounds(windows, series, boundary="nearest", tol_minutes=tol_minutes)


def outcome_target(bounded: DataFrame) -> DataFrame:
    """Target, status and flags from ``ri_start`` / ``ri_end``; a missing target stays NULL."""
    t0, t1 = F.col("ri_start").isNull(), F.col("ri_end").isNull()
    return bounded.withColumns(
        {
            "delta_ri": F.col("ri_end") - F.col("ri_start"),
            "outcome_status": F.when(t0 | t1, F.lit(C.STATUS_INSUFFICIENT_OUTCOME)).otherwise(F.lit(C.STATUS_DEFENSIBLE)),
            "missing_loinc_85556_9_t0": t0.cast("long"),
            "missing_loinc_85556_9_t1": t1.cast("long"),
            "missing_delta_ri": (t0 | t1).cast("long"),
            "ri_window_start": F.when(t0 | t1, F.lit(0.0)).otherwise(F.col("ri_start")),
        }
    )


def component_missingness(
    targeted: DataFrame,
    observations: DataFrame,
    *,
    boundary: str = "first_last",
    tol_minutes: int = 60,
    codes: tuple[str, ...] = C.COMPONENT_CODES,
) -> DataFrame:
    """Long table (window, code, anchor, missing) for windows whose acuity is missing at that anchor."""
    pad = tol_minutes if boundary == "nearest" else 0
    base = targeted.filter(F.col("missing_delta_ri") == 1).select(
        *WINDOW_KEYS,
        F.explode(
            F.filter(
                F.array(
                    F.struct(F.lit("t0").alias("anchor"), F.col("outcome_window_start").alias("at"), F.col("missing_loinc_85556_9_t0").alias("on")),
                    F.struct(F.lit("t1").alias("anchor"), F.col("outcome_window_end").alias("at"), F.col("missing_loinc_85556_9_t1").alias("on")),
                ),
                lambda x: x["on"] == 1,
            )
        ).alias("_k"),
        plus_minutes("outcome_window_start", -pad).alias("low"),
        plus_minutes("outcome_window_end", pad).alias("high"),
    )
    points = _loinc(observations).select(
        "episode_id", F.trim("code").alias("code"), "effective_dt", "obs_id", F.col("value_num").cast("double").alias("value_num")
    ).filter(F.col("code").isin(list(codes)))
    # Only codes that an episode has at all go into the sort; the others ride along in one row per anchor and are missing.
    seen = points.groupBy("episode_id").agg(F.collect_set("code").alias("_seen"))
    have = F.array_intersect(string_array(codes), F.coalesce("_seen", F.array().cast("array<string>")))
    kept = lambda code, rest: F.struct(code.alias("code"), rest.alias("rest"))
    sorted_ones = F.transform(have, lambda c: kept(c, F.array().cast("array<string>")))
    asked = F.concat(sorted_ones, F.array(kept(F.lit(""), F.array_except(string_array(codes), have))))
    wanted = base.join(seen, "episode_id", "left").select(
        "episode_id",
        F.inline(asked),
        "window_index",
        F.col("_k.anchor").alias("anchor"),
        # An unobserved range has no end; its rows are kept and found missing by the range test below.
        F.coalesce(F.col("_k.at"), F.col("low")).alias("at"),
        "low",
        "high",
    )
    found = asof_bounds(
        wanted,
        points,
        keys=["episode_id", "code"],
        anchor_ts="at",
        point_ts="effective_dt",
        point_cols=["obs_id", "value_num"],
    )
    value = _nearest(F.col("prev"), F.col("next"), F.col("at"), F.col("low"), F.col("high"), tol_minutes)
    rest = F.col("code") == ""
    judged = found.withColumn("missing", F.when(rest, F.lit(1)).otherwise(value.isNull().cast("int")).cast("long"))
    return judged.select(*WINDOW_KEYS, F.explode(F.when(rest, F.col("rest")).otherwise(F.array("code"))).alias("code"), "anchor", "missing")


def component_flags_wide(long: DataFrame, codes: tuple[str, ...] = C.COMPONENT_CODES) -> DataFrame:
    """Wide form of ``component_missingness``: one ``missing_loinc_<code>_<anchor>`` column per pair."""
    return long.groupBy(*WINDOW_KEYS).agg(
        *[
            F.max(F.when((F.col("code") == c) & (F.col("anchor") == a), F.col("missing"))).alias(
                f"missing_loinc_{c.replace('-', '_')}_{a}"
            )
            for c in codes
            for a in ("t0", "t1")
        ]
    )


# --- compositions ----------------------------------------------------------------------------


def episode_features(
    episodes: DataFrame, procedures: DataFrame, observations: DataFrame, shifts: DataFrame, *, as_of: datetime | str
) -> DataFrame:
    """One row per episode: acuity at admission, counts, staffing, vitals, specification, target."""
    spec = episode_temporal_spec(episodes, as_of=as_of)
    overlaps = roster_overlap(spec, shifts, ids=["episode_id"], start="admission", end="feature_window_end")
    staffing = staffing_exposure(spec, census_fallback(overlaps, episodes), ids=["episode_id"])
    return (
        spec.join(procedure_counts(spec, procedures, grain="episode"), "episode_id", "left")
        .join(staffing.select("episode_id", "nurse_hppd", "nurse_skillmix"), "episode_id", "left")
        .join(vitals_last(spec, observations, grain="episode"), "episode_id", "left")
        .withColumn("delta_ri", F.col("ri_final") - F.col("ri_initial"))
    )


def window_features(
    episodes: DataFrame,
    procedures: DataFrame,
    observations: DataFrame,
    shifts: DataFrame,
    *,
    window_hours: int = 12,
    follow_up_hours: int | None = None,
    align: str = "admission",
    boundary: str = "first_last",
    tol_minutes: int = 60,
    as_of: datetime | str,
) -> DataFrame:
    """One row per window: counts, staffing, vitals, specification, outcome and target."""
    follow_up = int(follow_up_hours) if follow_up_hours is not None else int(window_hours)
    if align == "shift":
        windows = shift_windows(episodes, shifts, window_hours=window_hours, as_of=as_of)
    else:
        windows = fixed_windows(episodes, window_hours=window_hours, as_of=as_of)
    spec = window_temporal_spec(windows, follow_up_hours=follow_up)
    signals = window_signals(windows, procedures, observations)
    overlaps = roster_overlap(windows, shifts, ids=WINDOW_KEYS, start="start_dt", end="end_dt")
    staffing = staffing_exposure(windows, census_fallback(overlaps, episodes), ids=WINDOW_KEYS)
    target = outcome_target(outcome_bounds(spec, ri_series(observations), boundary=boundary, tol_minutes=tol_minutes))
    full = target.join(signals, WINDOW_KEYS, "left").join(
        staffing.select(*WINDOW_KEYS, "nurse_hppd", "nurse_skillmix"), WINDOW_KEYS, "left"
    )
    return (
        _vital_columns(_zero_fill(full, COUNT_COLS))
        .withColumn("window_hours", hours_between("start_dt", "end_dt"))
        .withColumn("follow_up_hours", F.lit(float(follow_up)))
    )


# --- dataset-level ---------------------------------------------------------------------------


def schema_hash(feature_names: Column, target_names: Column) -> Column:
    """sha256 of the sorted feature names, '#', the sorted target names."""
    joined = [F.array_join(F.array_sort(a), "|") for a in (feature_names, target_names)]
    return F.sha2(F.concat_ws("#", *joined), 256)


def missing_rate_snapshot(df: DataFrame, *, columns: list[str] | None = None, top: int | None = None) -> DataFrame:
    """Null share of every column from one pass, the ``top`` largest, with row and column counts."""
    columns = columns or df.columns
    rates = df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[F.avg(F.col(c).isNull().cast("double")).alias(f"r{i}") for i, c in enumerate(columns)],
    )
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"r{i}").alias("missing_rate")) for i, c in enumerate(columns)])
    return (
        rates.select("n_rows", F.lit(len(columns)).cast("long").alias("n_cols"), F.inline(pairs))
        .orderBy(F.col("missing_rate").desc(), "column")
        .limit(len(columns) if top is None else top)
    )


def causal_outcome_recompute(
    stored: DataFrame,
    series: DataFrame,
    *,
    horizon_hours: int,
    boundary: str = "first_last",
    tol_minutes: int = 60,
) -> DataFrame:
    """Outcome for a requested horizon: the stored one when its range is the wanted one, else recomputed.

    ``stored`` carries the specification, ``discharge``, ``delta_ri`` and the three missing flags.
    The nearest boundary looks at the whole episode series, as-of on both sides.
    """
    had = F.col("outcome_window_start").isNotNull() | F.col("outcome_window_end").isNotNull()
    wanted_end = plus_hours("feature_window_end", horizon_hours)
    cut = F.coalesce(F.col("discharge") < wanted_end, F.lit(False))
    spec = stored.select(
        "*",
        F.col("feature_window_end").alias("_os"),
        F.when(cut, F.col("discharge")).otherwise(wanted_end).alias("_oe"),
        F.when(cut, F.lit("discharged_before_outcome_window_end")).otherwise(F.lit("not_censored")).alias("_censor"),
    ).withColumn(
        "reuse",
        F.coalesce(
            (F.col("outcome_window_start") == F.col("_os"))
            & (F.col("outcome_window_end") == F.col("_oe"))
            & (F.col("outcome_window_start") <= F.col("outcome_window_end")),
            F.lit(False),
        ),
    )
    looked = _lookup(spec.filter(~F.col("reuse")), series, {"t0": F.col("_os"), "t1": F.col("_oe")})
    joined = spec.join(looked, WINDOW_KEYS, "left")
    if boundary == "nearest":
        counts = series.groupBy("episode_id").agg(F.count(F.lit(1)).alias("_n"))
        joined = joined.join(counts, "episode_id", "left")
        enough = F.coalesce(F.col("_n") >= 2, F.lit(False))
        start = _nearest(F.col("t0_prev"), F.col("t0_next"), F.col("_os"), None, None, tol_minutes)
        end = _nearest(F.col("t1_prev"), F.col("t1_next"), F.col("_oe"), None, None, tol_minutes)
    else:
        enough = _two_points(F.col("t0_next"), F.col("t1_prev"), F.col("_os"), F.col("_oe"))
        start, end = F.col("t0_next.value_num"), F.col("t1_prev.value_num")
    done = joined.withColumn("ri_start", F.when(enough, start)).withColumn("ri_end", F.when(enough, end))
    gone = F.col("ri_start").isNull() | F.col("ri_end").isNull()

    def either(old: str, new: Column) -> Column:
        return F.when(F.col("reuse"), F.col(old)).otherwise(new)

    return done.select(
        *WINDOW_KEYS,
        "reuse",
        F.col("_os").alias("outcome_window_start"),
        F.col("_oe").alias("outcome_window_end"),
        either("censoring_reason", F.col("_censor")).alias("censoring_reason"),
        either("delta_ri", F.col("ri_end") - F.col("ri_start")).alias("delta_ri"),
        either("missing_loinc_85556_9_t0", F.col("ri_start").isNull().cast("long")).alias("missing_loinc_85556_9_t0"),
        either("missing_loinc_85556_9_t1", F.col("ri_end").isNull().cast("long")).alias("missing_loinc_85556_9_t1"),
        either("missing_delta_ri", gone.cast("long")).alias("missing_delta_ri"),
        either("outcome_status", F.when(gone, F.lit(C.STATUS_INSUFFICIENT_OUTCOME)).otherwise(F.lit(C.STATUS_DEFENSIBLE))).alias(
            "outcome_status"
        ),
        compact(
            tag_if(had & ~F.col("reuse"), "outcome_recomputed_for_target_trial_horizon"),
            tag_if(had & ~F.col("reuse"), "stored_outcome_window_mismatch_target_trial"),
        ).alias("warnings"),
    )
