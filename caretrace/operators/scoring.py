"""A scoring request as a whole: evidence gate, cohort, feature contract, temporal guard, components, score."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caretrace.functions.columns import sorted_unique, string_array
from caretrace.operators import score as K
from caretrace.operators.cohort_score import score_cohort
from caretrace.operators.guards import validate_temporal
from caretrace.session import cut_lineage

NO_TEXT = "array<string>"
NUMBERS = ("score", "raw_score", *(c for part in K.C.COMPONENTS for c in (part, f"raw_{part}")), "confidence")


@dataclass(frozen=True)
class Request:
    """What is asked for. Stored rows are narrowed by the filters; rows of an outside provider bring features as a map."""

    rows: DataFrame
    grain: str = "window"
    reference_rows: DataFrame | None = None
    episode_ids: Sequence[int] | None = None
    unit_id: int | None = None
    date_from: str | None = None
    date_to: str | None = None
    #: Contracts by role (primary, baseline): given, the rows are an outside provider's, numbered by ``index``.
    contracts: tuple[K.FeatureContract, ...] = ()
    index: str = "idx"
    #: Map column of the temporal specification, and the map column of feature times; without the first, time is not checked.
    temporal_spec: str | None = "temporal_spec"
    stamps: str | None = None


def evidence_detail(artifact: DataFrame, baseline_asked: bool = False, baseline: DataFrame | None = None) -> DataFrame:
    """One row (detail, statuses): why a request is refused before any row is read, NULL when it is not.

    Both arguments are judged artifact tables (:func:`~caretrace.operators.model.evidence_gate`) of at most one row.
    """
    sound = lambda a: a.agg(F.coalesce(F.bool_and("defensible"), F.lit(False)).alias("d")).scalar()
    found = baseline.agg((F.count(F.lit(1)) > 0).alias("f")).scalar() if baseline is not None else F.lit(False)
    said = artifact.select(F.explode("statuses").alias("s")).distinct().agg(F.array_sort(F.collect_list("s")).alias("s")).scalar()
    detail = F.when(~sound(artifact), F.lit("model_not_defensible"))
    if baseline_asked or baseline is not None:
        detail = detail.when(~found, F.lit("baseline_model_not_found"))
        if baseline is not None:
            detail = detail.when(~sound(baseline), F.lit("baseline_model_not_defensible"))
    return artifact.sparkSession.range(1).select(detail.alias("detail"), said.alias("statuses"))


def _cohorts(request: Request, features: Sequence[str], target: str) -> tuple[DataFrame, DataFrame]:
    if not request.contracts:
        chosen, reference = K.select_cohort(
            request.rows, grain=request.grain, episode_ids=request.episode_ids, unit_id=request.unit_id, date_from=request.date_from, date_to=request.date_to
        )
        if request.reference_rows is not None:
            reference = request.reference_rows
        absent = lambda df: df.withColumns({f: F.lit(0.0) for f in features if f not in df.columns})
        asked = absent(chosen)
        return asked, asked if reference is chosen else absent(reference)

    names = list(dict.fromkeys([*features, target, *(f for c in request.contracts for f in c.features)]))

    def flat(df: DataFrame) -> DataFrame:
        normal = K.normalize_external_rows(df, index=request.index)
        flags = [f"missing_{n}" for n in names if not n.startswith("missing_")]
        at = lambda n: F.try_element_at("features", F.lit(n))
        return normal.withColumns({n: at(n) for n in names} | {n: F.coalesce(at(n), F.lit(0.0)) for n in flags}).drop("features", "missingness_flags")

    chosen = flat(request.rows)
    return chosen, chosen if request.reference_rows is None else flat(request.reference_rows)


def _union(df: DataFrame, column: str) -> Column:
    """All texts of an array column, sorted; single texts are made distinct before they are gathered."""
    return df.select(F.explode(column).alias("w")).distinct().agg(F.array_sort(F.collect_list("w")).alias("w")).scalar()


def _contract_blocks(request: Request) -> DataFrame | None:
    """(index, status, warnings) of every requested row when anything breaks a contract, else no rows."""
    if not request.contracts:
        return None
    issues = lambda df: [K.feature_contract(df, c, index=request.index) for c in request.contracts]

    def all_of(parts: list[DataFrame]) -> DataFrame:
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    # The findings are read by several gates: they are written once.
    own = cut_lineage(all_of(issues(request.rows)))
    reference = cut_lineage(all_of(issues(request.reference_rows))) if request.reference_rows is not None else own.filter(F.lit(False))
    return K.block_by_reference_or_batch(request.rows, own, reference, index=request.index, keep_index=True)


def score_request(
    request: Request,
    *,
    artifact: DataFrame,
    model,
    governed: Sequence[str],
    target: str,
    drift: DataFrame,
    q_hat: float | None,
    train_rows: int,
    baseline_asked: bool = False,
    baseline_artifact: DataFrame | None = None,
    baseline_model=None,
    causal=None,
    goal: str = "higher_is_better",
    spec: K.ScoreSpec = K.DEFAULT,
) -> DataFrame:
    """Rows of the request with status, warnings and, where no gate is shut, their numbers; one plan over either model.

    The gates in order: a model whose evidence is not defensible refuses the request (no rows, see
    :func:`evidence_detail`); a row, or a reference row, that breaks the feature contract blocks every row; so does one that
    breaks the temporal rules. A row with a finding of its own names it, the others name what blocked them. The gates
    are scalar subqueries: they are evaluated once, and no row is joined to them but those of the contract, by number.
    """
    features = list(dict.fromkeys([*model.features, *(baseline_model.features if baseline_model is not None else ())]))
    chosen, reference = _cohorts(request, features, target)
    detail = evidence_detail(artifact, baseline_asked, baseline_artifact).select("detail").scalar()
    timed = request.temporal_spec is not None
    if timed:
        check = lambda df: validate_temporal(df, spec=request.temporal_spec, stamps=request.stamps, feature_names=features, target=target)
        keep = ("temporal_status", "temporal_warnings")
        narrow = lambda df, found: found.select(*df.columns, *keep).withColumnsRenamed({c: f"_own_{c}" for c in keep})
        same = chosen is reference
        chosen = narrow(chosen, check(chosen))
        reference = chosen if same else narrow(reference, check(reference))
    written: dict[str, DataFrame] = {}
    scored = score_cohort(
        chosen, reference, model=model, governed=governed, target=target, drift=drift, q_hat=q_hat, train_rows=train_rows, causal=causal, baseline_model=baseline_model, goal=goal, spec=spec, written=written
    ).filter(detail.isNull())

    blocks: list[tuple[Column, Column, Column]] = []
    contract = _contract_blocks(request)
    if contract is not None:
        named = contract.select(F.col(request.index).alias("_c_index"), F.col("status").alias("_c_status"), F.col("warnings").alias("_c_warnings"))
        scored = scored.join(named, F.col(request.index) == F.col("_c_index"), "left").drop("_c_index")
        blocks.append((F.col("_c_status").isNotNull(), F.col("_c_status"), F.col("_c_warnings")))
    if timed:
        any_bad = lambda df: df.agg(F.coalesce(F.bool_or(F.col("_own_temporal_status").isNotNull()), F.lit(False)).alias("b")).scalar()
        own = F.col("_own_temporal_status")
        rows, against = written["selected"], written["reference"]
        scored = scored.withColumns({"_t_batch": any_bad(rows), "_t_ref": any_bad(against), "_t_ref_warnings": _union(against, "_own_temporal_warnings")})
        by_ref = F.concat(string_array(["scoring_blocked_by_reference_rows_temporal_failure"]), F.col("_t_ref_warnings"))
        status = F.when(own.isNotNull(), own).when(F.col("_t_ref"), F.lit("blocked_by_reference_temporal_spec")).otherwise(F.lit("temporal_leakage_blocked"))
        warned = F.when(own.isNotNull(), F.col("_own_temporal_warnings")).when(F.col("_t_ref"), by_ref).otherwise(string_array(["scoring_blocked_by_batch_temporal_failure"]))
        blocks.append((F.col("_t_batch") | F.col("_t_ref"), status, sorted_unique(warned)))
    shut, status, warned = F.lit(False), F.col("status"), F.col("warnings")
    for closed, s, w in reversed(blocks):
        shut, status, warned = shut | closed, F.when(closed, s).otherwise(status), F.when(closed, w).otherwise(warned)
    numbers = [c for c in NUMBERS if c in scored.columns]
    helpers = [c for c in scored.columns if c.startswith(("_c_", "_t_", "_own_"))]
    staged = scored.withColumns({"_shut": shut, "_status": status, "_warned": warned})
    return (
        staged.withColumns({c: F.when(~F.col("_shut"), F.col(c)) for c in numbers} | {"status": F.col("_status"), "warnings": F.col("_warned"), "provisional": F.col("provisional") & ~F.col("_shut")})
        .drop(*helpers, "_shut", "_status", "_warned")
    )


def request_outcome(rows: DataFrame, gate: DataFrame) -> DataFrame:
    """One row: detail of a refused or empty request, row counts, counts by status, union of warnings.

    ``rows`` are read several times: pass them written or checkpointed.
    """
    counts = rows.groupBy("status").agg(F.count(F.lit(1)).alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("status", "n")))).alias("status_counts"))
    head = rows.agg(F.count(F.lit(1)).alias("rows_requested"), F.count("score").alias("rows_scored"))
    reason = F.coalesce(gate.select("detail").scalar(), F.when(F.col("rows_requested") == 0, F.lit("no_rows_available_for_scoring")))
    none = F.array().cast(NO_TEXT)
    return head.select(reason.alias("detail"), "rows_requested", "rows_scored", counts.scalar().alias("status_counts"), F.coalesce(_union(rows, "warnings"), none).alias("warnings"))
