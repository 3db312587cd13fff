"""Invariants of the model jobs on the smallest tables."""

from pyspark.sql import functions as F

from runscore.operators import models as M
from runscore.plans import model_queries as Q


def numbers(spark, n=3000, hot=1000):
    """Pairs of equal numbers; a third of the rows are copies of one."""
    value = F.when(F.col("id") < hot, F.lit(-1)).otherwise(F.col("id")).cast("double")
    return spark.range(n).select(value.alias("a"), value.alias("b"))


def test_permuted_column_keeps_its_values(spark):
    rows = numbers(spark)
    mixed = M.permuted(rows, "a").collect()
    assert sorted(r["a"] for r in mixed) == sorted(r["b"] for r in mixed) == sorted(r["a"] for r in rows.collect())
    # only copies of the hot row can meet their own value, a third of them by chance
    same = [r["a"] for r in mixed if r["a"] == r["b"]]
    assert set(same) <= {-1.0} and 230 < len(same) < 440


def test_permutation_depends_on_rows_and_seed_only(spark):
    rows = numbers(spark, 500, 100)
    seen = []
    for parts, batch in ((1, 10_000), (7, 10), (3, 100)):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        seen.append(sorted(map(tuple, M.permuted(rows.repartition(parts), "a").collect())))
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert seen[0] == seen[1] == seen[2]
    assert sorted(map(tuple, M.permuted(rows, "a", seed=7).collect())) != seen[0]


def test_permutation_is_a_shift_of_a_random_order(spark):
    rows = spark.range(400).select(F.col("id").cast("double").alias("a"), (-F.col("id")).cast("double").alias("b"))
    numbered = M.ranked(rows)
    order = {r["__rank"]: r["a"] for r in numbered.collect()}
    assert sorted(order) == list(range(400)) and [order[i] for i in range(400)] != sorted(order.values())
    moved = {-r["b"]: r["a"] for r in M.with_shifted(numbered, "a", 400, 5).collect()}
    shifts = {(list(order.values()).index(moved[a]) - i) % 400 for i, a in order.items()}
    place = {a: i for i, a in order.items()}
    assert len({(place[moved[a]] - i) % 400 for i, a in order.items()}) == 1 and shifts != {0}


def test_one_row_and_none_are_permuted(spark):
    one = spark.createDataFrame([(1.0, 2.0)], "a double, b double")
    assert [tuple(r) for r in M.permuted(one, "a").collect()] == [(1.0, 2.0)]
    assert M.permuted(one.where("false"), "a").count() == 0


def test_importance_of_a_feature_that_decides(spark):
    rows = spark.range(600).select(
        F.col("id").alias("k"), (F.col("id") % 10).cast("double").alias("x"),
        F.pmod(F.xxhash64("id"), F.lit(7)).cast("double").alias("noise"), (F.col("id") % 10 >= 5).cast("int").alias("y"),
    )
    found = M.feature_importance(rows, M.ModelSpec("y", "k", ("x", "noise"), params={"numTrees": 5}))
    got = {r["feature"]: r["permutation_importance"] for r in found.collect()}
    assert got["x"] > 0.3 and abs(got["noise"]) < 0.05


def test_forest_finds_the_signal(spark, sf):
    row = M.train_eval(Q.labelled(spark, sf), Q.spec()).first()
    assert 0.0 <= row["accuracy"] <= 1.0 and 0.0 <= row["auc"] <= 1.0


def test_learnable_target(spark):
    rows = spark.range(600).select(
        F.col("id").alias("k"), (F.col("id") % 10).cast("double").alias("x"),
        ((F.col("id") % 10) >= 5).cast("int").alias("y"),
    )
    row = M.train_eval(rows, M.ModelSpec("y", "k", ("x",), params={"numTrees": 5})).first()
    assert row["accuracy"] == 1.0 and row["auc"] == 1.0


def test_missing_target_is_an_error(spark, sf):
    import pytest

    with pytest.raises(ValueError, match="not found"):
        M.baseline_model(Q.labelled(spark, sf), "nothing", "l_orderkey")


def test_counterfactual_prefers_fewer_changes(spark, sf):
    rows = Q.counterfactuals(spark, sf)
    worst = rows.agg(F.max("changes"), F.min("changes"), F.count("*"), F.count_distinct("row_key")).first()
    assert worst[1] == 1 and worst[0] <= 2 and worst[2] == worst[3]
    assert spark.sparkContext._jsc.sc().getPersistentRDDs().size() == 0


def test_counterfactuals_equal_the_whole_grid(spark):
    rows = spark.range(300).select(
        F.concat(F.lit("k"), "id").alias("key"), (F.col("id") % 17).cast("double").alias("a"),
        (F.col("id") % 13).cast("double").alias("b"), ((F.col("id") % 17) + (F.col("id") % 13) > 14).cast("int").alias("y"),
    )
    spec = M.ModelSpec("y", "key", ("a", "b"), model="logistic")
    split = M.prepare(rows, spec)
    model = M.fit(split, spec)
    chosen = model.transform(split.rows).where("prediction = 1.0").select("row_key", "a", "b").persist()
    edits = [{"a": 4.0, "b": 2.0}, {"a": 9.0}, {"b": 8.0}, {"a": 7.0}, {"a": 0.0, "b": 0.0}]
    got = {r["row_key"]: (r["changes"], r["edit"]) for r in M.counterfactuals(chosen, model, edits, "row_key", 0.0).collect()}
    wanted = {}
    for number, edit in enumerate(edits):
        changed = chosen.withColumns({n: F.lit(v) for n, v in edit.items()})
        for r in model.transform(changed).where("prediction = 0.0").collect():
            best = (len(edit), number)
            wanted[r["row_key"]] = min(best, wanted.get(r["row_key"], best))
    assert got == wanted and len({c for c, _ in got.values()}) == 2
    assert M.counterfactuals(chosen, model, [], "row_key", 0.0).count() == 0
    chosen.unpersist()
    split.release()


def test_queries_train_whole_models(spark, sf, monkeypatch):
    import pytest

    made, build = [], M.estimator

    class Stop(Exception):
        pass

    def seen(spec):
        made.append((spec.model, build(spec)))
        raise Stop

    monkeypatch.setattr(M, "estimator", seen)
    jobs = (Q.baseline_model, Q.logistic, Q.boosting, Q.forest_regression, Q.feature_importance, Q.counterfactuals)
    for job in jobs:
        with pytest.raises(Stop):
            job(spark, sf)
    monkeypatch.setattr(M, "compare_models", lambda rows, specs, metric: made.extend((s.model, build(s)) for s in specs.values()))
    Q.compare_models(spark, sf)
    assert len(made) == len(jobs) + 3
    for model, stage in made:
        if model == "random_forest":
            assert (stage.getNumTrees(), stage.getMaxDepth()) == (100, 10)
        else:
            assert stage.getMaxIter() == {"logistic": 100, "gradient_boosting": 20}[model]


def line_rows(spark, n=12_000):
    """Two inputs of few values, one of many, gaps and a category; the label follows a, c and the category."""
    a, c = F.col("id") % 7, F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000
    return spark.range(n).select(
        F.col("id").alias("k"), F.when(F.col("id") % 11 != 0, a.cast("double")).alias("a"), c.alias("c"),
        F.when(F.col("id") % 13 != 0, F.concat(F.lit("s"), F.col("id") % 3)).alias("s"),
        (a * 10 + F.floor(c * 4) * 5 + (F.col("id") % 3) * 3 + F.pmod(F.hash("id"), F.lit(10)) / 10).alias("y"),
    )


def regression_spec(**changes):
    return M.ModelSpec("y", "k", ("a", "c"), ("s",), task="regression", params={"numTrees": 12, "maxDepth": 8}, **changes)


def test_trees_walk_cells_not_rows(spark, monkeypatch):
    seen, build = [], M.RandomForestRegressor._fit
    monkeypatch.setattr(M.RandomForestRegressor, "_fit", lambda self, rows: seen.append(rows.count()) or build(self, rows))
    rows, spec = line_rows(spark), regression_spec()
    split = M.prepare(rows, spec)
    by_cell = M.fit(split, spec)
    assert len(seen) == 12 and max(seen) <= 8 * 32 * 3 < split.train.count() / 8
    by_row = M.pipeline(spec).fit(split.train)
    r2 = [M.evaluate(m.transform(split.test), spec).first()["r2"] for m in (by_cell, by_row)]
    assert min(r2) > 0.6 and abs(r2[0] - r2[1]) < 0.05
    forest = by_cell.stages[-1]
    assert forest.getNumTrees == 12 and max(t.depth for t in forest.trees) == 8
    weights = [m.stages[-1].featureImportances.toArray() for m in (by_cell, by_row)]
    assert abs(weights[0] - weights[1]).max() < 0.1 and abs(weights[0].sum() - 1) < 1e-9
    split.release()
    assert spark.sparkContext._jsc.sc().getPersistentRDDs().size() == 0


def test_every_row_is_drawn_on_its_own(spark):
    from runscore.operators import forest

    rows = spark.range(40_000).select((F.col("id") % 50).alias("code"), (F.col("id") % 50).cast("double").alias("label"))
    cells = forest.drawn_cells(rows.repartition(3), 20, 1, 50).collect()
    assert sorted(r["code"] for r in cells) == list(range(50))
    drawn = [w for r in cells for w in r["weights"]]
    mean = sum(drawn) / len(drawn)
    spread = sum((w - 800) ** 2 for w in drawn) / len(drawn)
    assert abs(mean - 800) < 4 and 650 < spread < 950  # sums of 800 Poisson numbers of mean 1
    assert all(s == w * r["code"] for r in cells for w, s in zip(r["weights"], r["sums"]))


def test_inputs_without_repeats_are_fitted_row_by_row(spark):
    rows = spark.range(500).select(F.col("id").alias("k"), F.rand(1).alias("a"), F.rand(2).alias("c"), F.lit("s").alias("s"), F.rand(3).alias("y"))
    split = M.prepare(rows, regression_spec())
    whole = M.pipeline(regression_spec()).getStages()[-1]
    assert M.fit_cells(split.train, regression_spec(), whole) is None
    assert M.fit(split, regression_spec()).stages[-1].getNumTrees == 12
    split.release()


def test_ranges_of_few_and_many_values(spark):
    from runscore.operators import forest

    rows = spark.range(3200).select((F.col("id") % 4).cast("double").alias("a"), F.col("id").cast("double").alias("b"), F.lit(1.0).alias("c"))
    few, many, one = forest.range_bounds(rows, ["a", "b", "c"], 32)
    assert few[1:-1] == [0.5, 1.5, 2.5] and len(many) == 33 and one[1:-1] == [0.0]
    assert max(abs(b - a - 100) for a, b in zip(many[1:], many[2:-1])) < 15


def test_grouped_r2_equals_that_of_the_rows(spark):
    rows, spec = line_rows(spark, 2000), regression_spec()
    split = M.prepare(rows, spec)
    model = M.fit(split, spec)
    grouped = M.grouped_r2(split.test, model, ["a", "c", "s"]).first()["r2"]
    assert abs(grouped - M.evaluate(model.transform(split.test), spec).first()["r2"]) < 1e-9
    split.release()


def class_spec(model="random_forest", **params):
    return M.ModelSpec("y", "k", ("a", "c"), ("s",), model, params=params)


def class_rows(spark, classes):
    """Rows of few cells; the class follows the label of line_rows, with some noise."""
    level = F.floor(F.col("y") / 100 * classes)
    odd = F.pmod(F.hash("k", F.lit(1)), F.lit(9)) == 0
    return line_rows(spark).withColumn("y", F.when(odd, F.col("k") % classes).otherwise(F.least(level, F.lit(classes - 1))))


def rows_seen(monkeypatch, kind):
    seen, build = [], kind._fit
    monkeypatch.setattr(kind, "_fit", lambda self, rows: seen.append(rows.count()) or build(self, rows))
    return seen


def test_classes_of_cells_are_counted(spark, monkeypatch):
    spec = class_spec(numTrees=12, maxDepth=8)
    with M.prepare(class_rows(spark, 3), spec) as split:
        seen = rows_seen(monkeypatch, M.RandomForestClassifier)
        by_cell = M.fit(split, spec)
        # at most 8 ranges of a, 32 of c, 3 categories and 3 classes
        assert len(seen) == 12 and max(seen) <= 8 * 32 * 3 * 3 < split.train.count() / 4
        by_row = M.pipeline(spec).fit(split.train)
        assert len(seen) == 13 and seen[-1] == split.train.count()
        scores = [M.evaluate(m.transform(split.test), spec).first() for m in (by_cell, by_row)]
        assert min(s["accuracy"] for s in scores) > 0.8 and abs(scores[0]["accuracy"] - scores[1]["accuracy"]) < 0.04
        assert abs(scores[0]["auc"] - scores[1]["auc"]) < 0.04
        forest = by_cell.stages[-1]
        assert (forest.getNumTrees, forest.numClasses) == (12, 3) and max(t.depth for t in forest.trees) == 8
        weights = [m.stages[-1].featureImportances.toArray() for m in (by_cell, by_row)]
        assert abs(weights[0] - weights[1]).max() < 0.15
        # a row stands for all test rows of its cell and class, and metrics are those of the rows
        counted = M.evaluated(by_cell, split.test, spec).first()
        assert all(abs(counted[c] - scores[0][c]) < 1e-9 for c in counted.asDict())
    assert spark.sparkContext._jsc.sc().getPersistentRDDs().size() == 0


def test_boosting_weighs_cells_by_their_rows(spark, monkeypatch):
    spec = class_spec("gradient_boosting", maxIter=4)
    with M.prepare(class_rows(spark, 2), spec) as split:
        seen = rows_seen(monkeypatch, M.GBTClassifier)
        by_cell = M.fit(split, spec)
        assert len(seen) == 1 and seen[0] <= 8 * 32 * 3 * 2 < split.train.count() / 4
        by_row = M.pipeline(spec).fit(split.train)
        scores = [M.evaluate(m.transform(split.test), spec).first() for m in (by_cell, by_row)]
        assert scores[0]["accuracy"] > 0.85 and abs(scores[0]["accuracy"] - scores[1]["accuracy"]) < 0.03
        counted = M.evaluated(by_cell, split.test, spec).first()
        assert all(abs(counted[c] - scores[0][c]) < 1e-9 for c in counted.asDict())
        assert M.train_eval(class_rows(spark, 2), spec).first()["accuracy"] > 0.85
    assert spark.sparkContext._jsc.sc().getPersistentRDDs().size() == 0


def test_boosting_of_counts_equals_that_of_rows(spark):
    # with few values of every input the ranges are the same, and so are the trees
    rows = spark.range(4000).select(
        F.col("id").alias("k"), (F.col("id") % 7).cast("double").alias("a"), F.pmod(F.hash("id"), F.lit(5)).cast("double").alias("c"),
        F.concat(F.lit("s"), F.col("id") % 3).alias("s"),
        ((F.col("id") % 7 + F.pmod(F.hash("id"), F.lit(5)) + F.pmod(F.xxhash64("id"), F.lit(4))) > 6).cast("int").alias("y"),
    )
    spec = class_spec("gradient_boosting", maxIter=3)
    with M.prepare(rows, spec) as split:
        models = M.fit(split, spec), M.pipeline(spec).fit(split.train)
        first, second = (
            {r["row_key"]: (r["prediction"], r["p"]) for r in m.transform(split.test).withColumn("p", M.vector_to_array("probability")[1]).collect()}
            for m in models
        )
        assert any(isinstance(s, M.Bucketizer) for s in models[0].stages)
        assert all(first[k][0] == second[k][0] and abs(first[k][1] - second[k][1]) < 1e-9 for k in first)


def test_counts_are_drawn_like_rows(spark):
    from runscore.operators import forest

    counted = spark.range(400).select((F.col("id") % 2 * 50 + 3).alias("n"))
    drawn = forest.drawn_counts(counted.repartition(3), 50, 7).collect()
    for n in (3, 53):
        got = [r[f"weight{i}"] for r in drawn if r["n"] == n for i in range(50)]
        mean = sum(got) / len(got)
        spread = sum((w - mean) ** 2 for w in got) / len(got)
        assert len(got) == 10_000 and abs(mean - n) < n * 0.05 and abs(spread - n) < n * 0.15


def test_labels_that_are_no_classes_fail_as_before(spark):
    import pytest

    rows = class_rows(spark, 2).withColumn("y", F.col("y") + 0.5)
    for spec in (class_spec(numTrees=3), class_spec("gradient_boosting", maxIter=2)):
        with pytest.raises(Exception):
            M.train_eval(rows, spec)
    assert spark.sparkContext._jsc.sc().getPersistentRDDs().size() == 0
