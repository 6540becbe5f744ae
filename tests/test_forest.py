"""Effect forest: step effects, intervals, moments."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from caretrace.operators import causal as X
from caretrace.operators import forest as E


@pytest.fixture(scope="module")
def steps(spark):
    """Effect 1 below 0.4 of the modifier, 3 above; treatment depends on a confounder."""
    rng = np.random.default_rng(11)
    n = 6000
    m, other, w = rng.random(n), rng.random(n), rng.normal(size=n)
    t = 0.8 * w + rng.normal(size=n)
    y = np.where(m > 0.4, 3.0, 1.0) * t + 2.0 * w + rng.normal(size=n)
    rows = [(i, *map(float, v)) for i, v in enumerate(np.column_stack([m, other, w, t, y]))]
    return spark.createDataFrame(rows, "row_id long, m double, other double, w double, t double, y double").repartition(3).cache()


SPEC = X.CausalSpec("t", "y", ("w",), ("m", "other"), 5)


def test_step_effect_is_found_with_intervals(steps):
    small = E.ForestSpec(n_trees=80, depth=3, bag=4)
    forest = E.fit_forest(steps, SPEC, small)
    assert E.modifier_use(forest)[0][0] == "m"
    rows = E.effect_interval(E.forest_effects(steps, forest)).withColumn("truth", F.when(F.col("m") > 0.4, 3.0).otherwise(1.0)).toPandas()
    away = rows[(rows.m - 0.4).abs() > 0.05]
    assert (away.effect - away.truth).abs().mean() < 0.15
    linear = X.dml_effects(steps, SPEC).toPandas().set_index("row_id").effect.loc[away.row_id].to_numpy()
    assert (away.effect - away.truth).abs().mean() < 0.5 * np.abs(linear - away.truth).mean()
    covered = ((away.lower <= away.truth) & (away.truth <= away.upper)).mean()
    assert covered > 0.8 and (away.upper - away.lower).median() < 1.0
    again = E.fit_forest(steps.repartition(5), SPEC, small)
    assert np.array_equal(again.feature, forest.feature) and np.allclose(again.a, forest.a)


def test_one_level_is_the_best_split_of_all_rows(steps):
    whole = E.ForestSpec(n_trees=1, depth=1, honest=False, bins=64, min_leaf=50)
    forest = E.fit_forest(steps, SPEC, whole)
    r = X.residuals(steps, SPEC).toPandas()
    edges = {c: sorted(set(r[c].quantile(np.arange(1, 64) / 64, interpolation="lower"))) for c in ("m", "other")}
    fit = lambda part: (part._rt * part._ry).sum() ** 2 / (part._rt**2).sum()
    worth = {(c, e): fit(r[r[c] <= e]) + fit(r[r[c] > e]) for c, es in edges.items() for e in es if min((r[c] <= e).sum(), (r[c] > e).sum()) >= 50}
    c, _ = max(worth, key=worth.get)
    cut = forest.cut[0, 0]
    assert forest.modifiers[forest.feature[0, 0]] == c and worth[max(worth, key=worth.get)] == pytest.approx(fit(r[r[c] <= cut]) + fit(r[r[c] > cut]), rel=0.01)
    theta = lambda part: (part._rt * part._ry).sum() / (part._rt**2).sum()
    got = E.forest_effects(steps, forest).groupBy((F.col(c) > float(cut)).alias("right")).agg(F.min("effect").alias("lo"), F.max("effect").alias("hi")).collect()
    for row in got:
        want = theta(r[(r[c] > cut) == row.right])
        assert row.lo == pytest.approx(want) and row.hi == pytest.approx(want)


def test_odd_rows(spark, steps):
    """Missing values, no modifiers worth a split, few rows, no rows; a bound on the rows of a tree."""
    holes = steps.withColumns({"m": F.when(F.col("row_id") % 9 != 0, F.col("m")), "y": F.when(F.col("row_id") % 10 != 0, F.col("y")), "other": F.lit(1.0)})
    forest = E.fit_forest(holes, SPEC, E.ForestSpec(n_trees=8, depth=2, rows_per_tree=1000))
    assert not (forest.feature == 1).any()
    out = E.forest_effects(holes.withColumn("tags", F.array(F.lit("x"))), forest)
    assert out.count() == 6000 and out.filter("effect is null").count() == 0 and out.columns[-2:] == ["effect", "effect_se"]
    few = E.fit_forest(steps.limit(5), SPEC, E.ForestSpec(n_trees=4, depth=2))
    assert (few.feature == -1).all()
    none = E.fit_forest(steps.filter(F.lit(False)), SPEC, E.ForestSpec(n_trees=4, depth=2))
    assert E.forest_effects(steps, none).filter("effect is not null").count() == 0


@pytest.mark.parametrize("spec", [E.ForestSpec(n_trees=8, depth=3, bins=16), E.ForestSpec(n_trees=8, depth=2, rows_per_tree=600), E.ForestSpec(n_trees=1, depth=2, honest=False, bins=8)])
def test_trees_from_cells_are_those_of_levels(steps, spec, monkeypatch):
    """One pass over the rows grows what a pass for each level grows, and a table of cells says what the trees say."""
    rows = steps.withColumn("m", F.round("m", 2))
    seen = rows.sparkSession.sparkContext.accumulator(0)

    def count(batches):
        seen.add(1)
        yield from batches

    monkeypatch.setattr(E, "residuals", lambda df, s: X.residuals(df, s).mapInArrow(count, X.residuals(df, s).schema))
    cells = E.fit_forest(rows, SPEC, spec)
    passes = seen.value
    monkeypatch.setattr(E, "MOST_CELLS", 0)
    levels = E.fit_forest(rows, SPEC, spec)
    assert passes < seen.value - passes and np.array_equal(cells.feature, levels.feature) and np.array_equal(cells.cut, levels.cut)
    assert np.allclose(cells.a, levels.a) and np.allclose(cells.b, levels.b)
    x = np.random.default_rng(1).random((500, 2))
    x[:3] = [[np.inf, -np.inf], cells.cut[0, [0, 0]], [0.4, 0.4]]
    table = E._effects_by_cell(cells)
    for got, want in zip(table.effects(x), cells.effects(x), strict=True):
        assert np.array_equal(got, want, equal_nan=True)
