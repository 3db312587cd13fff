"""Least squares from sums of products against fits over the rows."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from runscore.operators import linear as L
from runscore.operators import models as M
from runscore.operators.prep import stratified_split

KIND = "k long, y double, a double, b double, far double, c string, same double, flat double"


def table(spark, n=400, seed=1):
    dice = random.Random(seed)
    rows = []
    for k in range(n):
        a, b, c = dice.gauss(0, 1), dice.uniform(5, 9), dice.choice("uvw")
        y = 3 * a - 2 * b + {"u": 0, "v": 5, "w": -1}[c] + dice.gauss(0, 0.3)
        rows.append((k, y, a if k % 9 else None, b if k % 7 else math.nan, 1.7e9 + a * b, c if k % 11 else None, 2 * b, 4.0))
    rows.append((n, None, 1.0, 1.0, 1.0, "u", 1.0, 4.0))  # without a label
    return spark.createDataFrame(rows, KIND)


def spec(*numeric, categorical=("c",), **more):
    return M.ModelSpec("y", "k", numeric, categorical, "linear", "regression", **more)


def by_rows(fitted, numeric, categorical):
    """Least squares over the collected rows with the same fills."""
    rows = fitted.rows.collect()
    train = [r for r in rows if r["is_train"]]

    def known(value):
        return value is not None and not (isinstance(value, float) and math.isnan(value))

    means = {c: np.mean([r[c] for r in train if known(r[c])]) for c in numeric}
    usual = {}
    for c in categorical:
        seen = [r[c] for r in train if known(r[c])]
        usual[c] = sorted(set(seen), key=lambda v: (-seen.count(v), v))

    def line(r):
        out = [1.0]
        out += [(r[c] if known(r[c]) else means[c]) - means[c] for c in numeric]
        for c in categorical:
            out += [float(r[c] == v) for v in usual[c][1:]]
        return out

    weights = np.linalg.lstsq(np.array([line(r) for r in train]), np.array([r["label"] for r in train]), rcond=None)[0]
    test = [r for r in rows if not r["is_train"]]
    error = np.array([r["label"] for r in test]) - np.array([line(r) for r in test]) @ weights
    spread = np.var([r["label"] for r in test]) * len(test)
    return {"rmse": math.sqrt(np.mean(error**2)), "r2": 1 - np.sum(error**2) / spread}


@pytest.mark.parametrize("numeric", [("a", "b"), ("a", "far", "flat"), ("a", "b", "same")])
def test_fit_equals_least_squares_over_rows(spark, numeric):
    fitted = L.fit_linear(table(spark), spec(*numeric))
    wanted = by_rows(fitted, numeric, ("c",))
    assert fitted.metrics() == pytest.approx(wanted, rel=1e-6)
    scored = fitted.rows.where("NOT is_train").withColumn("prediction", fitted.prediction())
    assert M.regression_metrics(scored).first().asDict() == pytest.approx(wanted, rel=1e-6)
    row = M.train_eval(table(spark), spec(*numeric)).first()
    assert row.asDict() == pytest.approx(wanted, rel=1e-6)


def test_every_subset_equals_its_own_fit(spark):
    fitted = L.fit_linear(table(spark), spec("a", "b", "far"))
    for size in range(4):
        for kept in itertools.combinations(["a", "b", "far"], size):
            alone = L.fit_linear(table(spark), spec(*kept, categorical=()))
            assert fitted.metrics(list(kept)) == pytest.approx(alone.metrics(), rel=1e-9)


def test_ablation_equals_refits(spark):
    groups = {"numbers": ["a", "b"], "kind": ["c"]}
    found = {r["feature_group"]: r for r in M.feature_group_ablation(table(spark), spec("a", "b"), groups, "r2").collect()}
    alone = {name: L.fit_linear(table(spark), spec(*[c for c in members if c != "c"], categorical=tuple(c for c in members if c == "c"))) for name, members in groups.items()}
    for name, fitted in alone.items():
        assert found[name]["alone"] == pytest.approx(fitted.metrics()["r2"])
    assert found["kind"]["removed"] == found["numbers"]["alone"]


def test_split_is_that_of_the_other_models(spark):
    rows = L.split_rows(table(spark), spec("a"))
    plain = stratified_split(table(spark).where("y IS NOT NULL"), None, "k")
    assert {(r["row_key"], r["is_train"]) for r in rows.collect()} == {(r["k"], r["is_train"]) for r in plain.collect()}


def test_unseen_and_missing_categories_count_as_the_usual_one(spark):
    design = L.Design({"a": 1.0}, {"c": ["u", "v"]}, 0.0)
    rows = spark.createDataFrame([(None, None), (math.nan, "new"), (3.0, "v")], "a double, c string")
    columns = [c.alias(str(i)) for i, (_, c) in enumerate(design.columns())]
    assert [tuple(r) for r in rows.select(*columns).collect()] == [(0.0, 0.0), (0.0, 0.0), (2.0, 1.0)]


def test_one_aggregate_serves_all_fits(spark, monkeypatch):
    calls = []
    gram = L.gram
    monkeypatch.setattr(L, "gram", lambda *a: calls.append(1) or gram(*a))
    M.feature_group_ablation(table(spark), spec("a", "b"), {"a": ["a"], "b": ["b"], "c": ["c"]}, "r2")
    assert len(calls) == 1


def test_wide_designs_go_to_the_pipeline(spark):
    wide = table(spark).withColumn("c", F.col("k").cast("string"))
    assert L.fit_linear(wide, spec("a")) is None
    assert M.train_eval(wide, spec("a", params={"regParam": 1.0})).first()["rmse"] > 0


def test_no_rows(spark):
    nothing = table(spark).where("false")
    with pytest.raises(ValueError, match="no training rows"):
        M.train_eval(nothing, spec("a"))
