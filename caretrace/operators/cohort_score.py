"""End-to-end cohort scoring: gate, components, normalisation, row score, all in one plan."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caretrace.functions.columns import nan_to_null
from caretrace.functions.quantiles import exact_medians
from caretrace.functions.tables import settled, with_stats
from caretrace.operators import score as K
from caretrace.operators.causal import CausalSpec, fit_effect
from caretrace.operators.model import LinearModel, baseline_prediction
from caretrace.operators.trees import Explainer, TreeEnsemble, explained, predicted
from caretrace.session import cut_lineage

RAW = ("benefit", "attribution", "causal", "quality", "uncertainty")


@dataclass(frozen=True)
class Scorer:
    """What scoring takes from a model, linear or boosted: prediction, baseline and attribution columns."""

    model: LinearModel | TreeEnsemble
    governed: tuple[str, ...]
    reference: DataFrame
    baseline: LinearModel | TreeEnsemble | None = None

    def prepare(self) -> Callable[[DataFrame], DataFrame]:
        """A function that adds prediction, baseline and ``_phi_<feature>``; all rows of the reference are the background."""
        if isinstance(self.model, TreeEnsemble):
            medians = None
            if self.baseline is None:
                cols = [c for c in self.governed if c in self.model.features]
                row = exact_medians(self.reference, {c: c for c in cols}).first() if cols else {}
                medians = {c: float(row[c] or 0.0) for c in cols}
            explainer = Explainer.of(self.model, self.reference)
            added = lambda df: explained(df, explainer, prefix="_phi_", replace=medians)
        else:
            phi = self.model.attribution()

            def added(df: DataFrame) -> DataFrame:
                if self.baseline is None:
                    df = baseline_prediction(df, self.model, governed=self.governed, reference=self.reference)
                return df.withColumns({"prediction": self.model.predict(), **{f"_phi_{f}": c for f, c in phi.items()}})

        if isinstance(self.baseline, TreeEnsemble):
            return lambda df: predicted(added(df), self.baseline, out="baseline")
        if self.baseline is not None:
            return lambda df: added(df).withColumn("baseline", self.baseline.predict())
        return added


def score_cohort(
    selected: DataFrame,
    reference: DataFrame,
    *,
    model: LinearModel | TreeEnsemble,
    governed: Sequence[str],
    target: str,
    drift: DataFrame,
    q_hat: float | None,
    train_rows: int,
    causal: CausalSpec | None = None,
    baseline_model: LinearModel | TreeEnsemble | None = None,
    goal: str = "higher_is_better",
    spec: K.ScoreSpec = K.DEFAULT,
    written: dict[str, DataFrame] | None = None,
) -> DataFrame:
    """Scored rows of the selected cohort, normalised by the reference cohort.

    ``drift`` is one row of <feature>_mean / <feature>_std. Both cohorts may carry ``temporal_status``;
    any finding in either blocks every number, and each row says why. ``written`` receives both cohorts with their raw
    components as they were written, for readers that would otherwise work out the cohorts once more.
    """
    effect = causal_rows = None
    if causal is not None:
        names = [causal.treatment, causal.outcome, *causal.confounders, *causal.modifiers]
        complete = reference.dropna(subset=list(dict.fromkeys(names)))
        causal_rows = complete.count()
        if causal_rows >= int(spec.min_causal_rows or 30):
            effect = fit_effect(complete, causal)
    sign = 1.0 if goal == "higher_is_better" else -1.0
    sd = settled(reference.agg(F.stddev_pop(nan_to_null(target)).alias("sd")))
    drift = settled(drift)
    with_model = Scorer(model, tuple(governed), reference, baseline_model).prepare()

    def raw_components(df: DataFrame) -> DataFrame:
        columns = df.columns
        based = with_stats(with_stats(with_model(df), drift, "_drift"), sd, "_sd")
        quality, _ = K.process_quality(columns, spec)
        distances = K.ood_distances(model.features, "_drift", columns)
        burdens = {
            "conformal_width": K.conformal_burden(F.lit(q_hat), F.col("_sd.sd")) if q_hat is not None else None,
            "missingness": K.missingness_burden(columns),
            "ood": K.ood_from_distances([F.col(f"_z_{f}") for f in distances], spec) if distances else None,
            "low_support": K.low_support_burden(F.lit(train_rows), F.lit(causal_rows) if causal_rows is not None else None, spec),
        }
        # Staged, so that the combining expressions read columns instead of repeating what is below them.
        live = {n: c for n, c in burdens.items() if c is not None}
        staged = based.withColumns({f"_z_{f}": z for f, z in distances.items()})
        staged = staged.withColumns({f"_b_{n}": c for n, c in live.items()})
        parts = {n: F.col(f"_b_{n}") if n in live else None for n in burdens}
        nothing = F.lit(None).cast("double")
        phi = {f: F.col(f"_phi_{f}") for f in model.features}
        attribution = K.relative_attribution(phi, governed, spec.attribution_epsilon)
        uncertainty = K.combine_uncertainty(parts, spec)
        helpers = [c for c in staged.columns if c not in columns and c.startswith(("_z_", "_phi_", "_b_", "_drift", "_sd"))]
        return staged.withColumns(
            {
                "governed_sum": sum((c for f, c in phi.items() if f in governed), F.lit(0.0)),
                "raw_benefit": K.benefit(nan_to_null(target), F.col("baseline"), goal) if target in columns else nothing,
                "raw_attribution": attribution if attribution is not None else nothing,
                "raw_causal": effect.column() * sign if effect is not None else nothing,
                "raw_quality": quality if quality is not None else nothing,
                "raw_uncertainty": uncertainty if uncertainty is not None else nothing,
                "raw_severity": F.col("baseline") * -sign,
                "low_support_burden": parts["low_support"],
                "ood_burden": parts["ood"] if parts["ood"] is not None else nothing,
            }
        ).drop(*helpers)

    cols = [f"raw_{c}" for c in RAW] + ["raw_severity"]
    # The raw components are read by several quantile passes: they are written once and read back.
    ref_rows = cut_lineage(raw_components(reference))
    rows = ref_rows if selected is reference else cut_lineage(raw_components(selected))
    if written is not None:
        written |= {"selected": rows, "reference": ref_rows}
    z = with_stats(rows, K.robust_stats(ref_rows, cols, spec), "_z")
    z = z.withColumns({c: K.z_from("_z", f"raw_{c}", spec=spec) for c in RAW})
    clipped = F.least(F.greatest(K.z_from("_z", "raw_severity", spec=spec), F.lit(0.0)), F.lit(float(spec.severity_clip or 2.0)))
    scored = K.row_flags(K.row_score(z, spec=spec), low_support="low_support_burden", ood="ood_burden")
    scored = scored.withColumn("severity_weight", F.when(F.col("raw_severity").isNotNull(), F.lit(1.0) + clipped).otherwise(F.lit(1.0))).drop("_z")
    if "temporal_status" not in selected.columns:
        return scored
    any_bad = lambda df: df.agg(F.coalesce(F.bool_or(F.col("temporal_status").isNotNull()), F.lit(False)).alias("b"))
    flagged = scored.withColumn("_own", any_bad(rows).scalar()).withColumn("_ref", any_bad(ref_rows).scalar())
    blocked = F.col("_own") | F.col("_ref")
    why = F.coalesce("temporal_status", F.when(F.col("_ref"), F.lit("blocked_by_reference_temporal_spec")).otherwise(F.lit("temporal_leakage_blocked")))
    return flagged.withColumns(
        {
            "status": F.when(blocked, why).otherwise(F.col("status")),
            "score": F.when(~blocked, F.col("score")),
            "raw_score": F.when(~blocked, F.col("raw_score")),
        }
    ).drop("_own", "_ref")
