"""Spark ML jobs: training, evaluation, importance, ablation, counterfactuals.

Functions marked *action* fit models. Loops run over models, feature groups or
features, never over rows.
"""

from __future__ import annotations

import math
import time
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    GBTClassificationModel,
    GBTClassifier,
    LogisticRegression,
    RandomForestClassificationModel,
    RandomForestClassifier,
)
from pyspark.ml.feature import (
    Bucketizer,
    Imputer,
    ImputerModel,
    OneHotEncoder,
    StandardScaler,
    StringIndexer,
    StringIndexerModel,
    VectorAssembler,
)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runscore.functions.rounding import total
from runscore.operators import forest
from runscore.operators.linear import fit_linear, is_plain_linear
from runscore.operators.ordered import attach, few_groups, running_totals
from runscore.operators.prep import modes, stratified_split, with_class_weights
from runscore.operators.profile import infer_task_type, numeric_columns
from runscore.runtime import scratch_path

SEED = 42
BUCKET_BITS = 12  # buckets of a random order
MOST_CLASSES = 100  # as in Spark's classifiers
COPIES = 4096  # copies of one row that a task makes at once
LABEL, PREDICTION, FEATURES = "label", "prediction", "features"
FOREST = {"numTrees": 100, "maxDepth": 10}  # trees as in the reference, whose depth has no limit
CLASSIFIERS = {
    "logistic": LogisticRegression,
    "random_forest": RandomForestClassifier,
    "gradient_boosting": GBTClassifier,
}
BY_CELL = {  # estimators that can walk cells, and the parameters they may have then
    RandomForestRegressor: {"numTrees", "maxDepth", "maxBins"},
    RandomForestClassifier: {"numTrees", "maxDepth", "maxBins"},
    GBTClassifier: {"maxIter", "maxDepth", "maxBins", "stepSize"},
}
BY_ROW = (ImputerModel, Bucketizer, StringIndexerModel)  # steps that say which cell a row is in
REGRESSORS = {
    "linear": LinearRegression,
    "random_forest": RandomForestRegressor,
    "gradient_boosting": GBTRegressor,
}


@dataclass(frozen=True)
class ModelSpec:
    """What to train on. ``key`` decides the split and must identify a row or unit."""

    target: str
    key: str
    numeric: tuple[str, ...] = ()
    categorical: tuple[str, ...] = ()
    model: str = "random_forest"
    task: str = "classification"
    train_share: float = 0.8
    balanced: bool = False
    params: dict = field(default_factory=dict)


# --- metrics from predictions (lazy) ----------------------------------------
def class_counts(
    df: DataFrame, label: str = LABEL, prediction: str = PREDICTION, n: str | None = None
) -> DataFrame:
    """Per class: actual, predicted and true-positive counts, from a confusion table.

    ``n`` names the number of rows that a row stands for.
    """
    confusion = df.groupBy(label, prediction).agg((F.sum(n) if n else F.count(F.lit(1))).alias("n"))
    hit = F.when(F.col(label) == F.col(prediction), F.col("n")).otherwise(F.lit(0))
    none = F.lit(0).cast("long")
    sides = F.array(
        F.struct(
            F.col(label).alias("class"), F.col("n").alias("actual"),
            none.alias("predicted"), hit.cast("long").alias("tp"),
        ),
        F.struct(
            F.col(prediction).alias("class"), none.alias("actual"),
            F.col("n").alias("predicted"), none.alias("tp"),
        ),
    )
    return (
        confusion.select(F.explode(sides).alias("s"))
        .select("s.*")
        .groupBy("class")
        .agg(*[F.sum(c).alias(c) for c in ("actual", "predicted", "tp")])
    )


def classification_metrics(
    df: DataFrame,
    label: str = LABEL,
    prediction: str = PREDICTION,
    positive: object | None = None,
    n: str | None = None,
) -> DataFrame:
    """accuracy, macro and weighted F1, and precision, recall and F1 of a positive class."""
    zero = F.lit(0.0)
    per_class = class_counts(df, label, prediction, n).select(
        "class",
        "actual",
        "tp",
        F.coalesce(F.try_divide("tp", "predicted"), zero).alias("precision"),
        F.coalesce(F.try_divide("tp", "actual"), zero).alias("recall"),
        F.coalesce(
            F.try_divide(2 * F.col("tp"), F.col("actual") + F.col("predicted")), zero
        ).alias("f1"),
    )
    wanted = [
        (F.sum("tp") / F.sum("actual")).alias("accuracy"),
        F.avg("f1").alias("f1_macro"),
        (F.sum(F.col("f1") * F.col("actual")) / F.sum("actual")).alias("f1_weighted"),
    ]
    if positive is not None:
        wanted += [
            F.coalesce(F.max(F.when(F.col("class") == positive, F.col(c))), zero).alias(c)
            for c in ("precision", "recall", "f1")
        ]
    return per_class.agg(*wanted)


def regression_metrics(
    df: DataFrame, label: str = LABEL, prediction: str = PREDICTION
) -> DataFrame:
    """RMSE and R2 from one aggregate."""
    y, error = F.col(label), F.col(label) - F.col(prediction)
    return df.agg(
        F.sqrt(F.avg(error * error)).alias("rmse"),
        (1.0 - F.try_divide(F.sum(error * error), F.var_pop(y) * F.count(y))).alias("r2"),
    )


def grouped_r2(rows: DataFrame, model: PipelineModel, inputs: list[str]) -> DataFrame:
    """R2 of a model that sees the inputs only; rows of equal inputs are predicted once.

    The squared errors of such rows are their variance and the squared gap
    between their mean and the prediction, times their number.
    """
    label = F.col(LABEL)
    groups = rows.groupBy(*inputs).agg(
        F.count(label).alias("__n"), F.avg(label).alias("__mean"), F.var_pop(label).alias("__spread")
    )
    gap = F.col("__mean") - F.col(PREDICTION)
    whole = rows.agg((F.var_pop(label) * F.count(label)).alias("whole")).scalar()
    error = F.sum(F.col("__n") * (gap * gap + F.col("__spread")))
    return model.transform(groups).agg((1.0 - F.try_divide(error, whole)).alias("r2"))


def auc(df: DataFrame, score: str, positive: Column, n: str | None = None) -> DataFrame:
    """Area under the ROC curve as the exact rank statistic, ties counted half.

    ``n`` names the number of rows that a row stands for.
    """

    def count_if(condition: Column) -> Column:
        return F.sum(F.when(condition, F.col("n")).otherwise(0)) if n else F.count_if(condition)

    rows = df.select(F.col(score).cast("double").alias("s"), positive.alias("p"), *[F.col(c).alias("n") for c in (n,) if c])
    counted = rows.groupBy("s").agg(count_if(F.col("p")).alias("pos"), count_if(~F.col("p")).alias("neg"))
    ranked = running_totals(counted, "s", ["neg"])
    wins = F.sum(F.col("pos").cast("double") * (F.col("neg_before") + F.col("neg") / 2.0))
    pairs = F.sum("pos").cast("double") * F.sum("neg").cast("double")
    return ranked.agg(F.try_divide(wins, pairs).alias("auc"))


# --- pipelines --------------------------------------------------------------
@dataclass(frozen=True)
class Prepared:
    """Split rows, and the persisted frame behind them."""

    rows: DataFrame
    held: DataFrame

    @property
    def train(self) -> DataFrame:
        return self.rows.where("is_train")

    @property
    def test(self) -> DataFrame:
        return self.rows.where(~F.col("is_train"))

    def release(self) -> None:
        self.held.unpersist()

    def __enter__(self) -> Prepared:
        return self

    def __exit__(self, *error: object) -> None:
        self.release()


def prepare(df: DataFrame, spec: ModelSpec) -> Prepared:
    """label, inputs, key and ``is_train`` (action, persists); unlabelled rows are dropped.

    Missing categories get the mode of the training rows.
    """
    stratify = "label" if spec.task == "classification" else None
    rows = df.where(F.col(spec.target).isNotNull()).select(
        F.col(spec.target).cast("double").alias(LABEL),
        *[F.col(c).cast("double").alias(c) for c in spec.numeric],
        *[F.col(c).cast("string").alias(c) for c in spec.categorical],
        F.col(spec.key).alias("row_key"),
    )
    # joined by class, all rows would stand in as many partitions as there are classes
    few = few_groups(rows, [LABEL]) if stratify or spec.balanced else True
    split = stratified_split(rows, stratify, "row_key", spec.train_share, few=few)
    if spec.balanced:
        split = with_class_weights(split, LABEL, few=few)
    held = split.persist()
    if not spec.categorical:
        return Prepared(held, held)
    train = held.where("is_train")
    fill = {c: modes(train, c).first() for c in spec.categorical}
    known = {c: row["mode"] for c, row in fill.items() if row and row["mode"] is not None}
    return Prepared(held.na.fill(known) if known else held, held)


def imputer(spec: ModelSpec) -> Imputer:
    filled = [f"{c}__filled" for c in spec.numeric]
    return Imputer(inputCols=list(spec.numeric), outputCols=filled, strategy="mean")


def pipeline(spec: ModelSpec, bounds: list[list[float]] | None = None) -> Pipeline:
    """Mean imputation and scaling, one-hot encoding, and the estimator.

    With ``bounds`` numbers become the numbers of their ranges after imputation.
    """
    stages, inputs = [], []
    if spec.numeric:
        filling = imputer(spec)
        stages.append(filling)
        numbers = filling.getOutputCols()
        if bounds is not None:
            numbers = [f"{c}__range" for c in spec.numeric]
            stages.append(Bucketizer(inputCols=filling.getOutputCols(), outputCols=numbers, splitsArray=bounds))
        stages += [
            VectorAssembler(inputCols=numbers, outputCol="numbers"),
            StandardScaler(inputCol="numbers", outputCol="scaled", withMean=True, withStd=True),
        ]
        inputs.append("scaled")
    if spec.categorical:
        indexed = [f"{c}__index" for c in spec.categorical]
        encoded = [f"{c}__onehot" for c in spec.categorical]
        stages += [
            StringIndexer(
                inputCols=list(spec.categorical), outputCols=indexed, handleInvalid="keep"
            ),
            OneHotEncoder(inputCols=indexed, outputCols=encoded, handleInvalid="keep"),
        ]
        inputs += encoded
    stages.append(VectorAssembler(inputCols=inputs, outputCol=FEATURES))
    stages.append(estimator(spec))
    return Pipeline(stages=stages)


def estimator(spec: ModelSpec):
    kinds = CLASSIFIERS if spec.task == "classification" else REGRESSORS
    made = kinds[spec.model](featuresCol=FEATURES, labelCol=LABEL, **spec.params)
    if made.hasParam("seed"):
        made.setSeed(SEED)
    if spec.balanced:
        made.setWeightCol("weight")
    return made


def fit(split: Prepared, spec: ModelSpec) -> PipelineModel:
    """Fit on the training rows only (action)."""
    whole = pipeline(spec).getStages()[-1]
    if type(whole) in BY_CELL and set(spec.params) <= BY_CELL[type(whole)]:
        if spec.numeric and not spec.balanced and not (whole.hasParam("numTrees") and whole.getNumTrees() == 1):
            model = fit_cells(split.train, spec, whole)
            if model is not None:
                return model
    return pipeline(spec).fit(split.train)


def fit_cells(
    train: DataFrame, spec: ModelSpec, whole: RandomForestRegressor | RandomForestClassifier | GBTClassifier
) -> PipelineModel | None:
    """A forest or boosted trees from the cells of the training rows (``operators/forest.py``, action).

    None where there are too many cells for the number of rows.
    """
    filling = imputer(spec)
    filled = filling.fit(train).transform(train)
    bounds = forest.range_bounds(filled, filling.getOutputCols(), whole.getMaxBins())
    steps = Pipeline(stages=pipeline(spec, bounds).getStages()[:-1]).fit(train).stages
    by_row = [s for s in steps if isinstance(s, BY_ROW)]
    sizes = {f"{c}__range": len(b) - 1 for c, b in zip(spec.numeric, bounds)}
    for step in by_row:
        if isinstance(step, StringIndexerModel):
            # one more for categories that are not known
            sizes |= {c: len(labels) + 1 for c, labels in zip(step.getOutputCols(), step.labelsArray)}
    if math.prod(sizes.values()) >= 2**63:
        return None
    coded = PipelineModel(by_row).transform(train).select(forest.cell_code(sizes).alias("code"), LABEL)
    by_cell = PipelineModel([s for s in steps if s not in by_row])
    if not isinstance(whole, RandomForestRegressor):
        model = fit_counts(coded, by_cell, sizes, spec, whole)
        return None if model is None else PipelineModel([*steps, model])
    seen = coded.agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("code").alias("cells")).first()
    if seen["n"] < forest.ROWS_PER_CELL * seen["cells"]:
        return None
    drawn = forest.drawn_cells(coded, whole.getNumTrees(), whole.getSeed(), seen["cells"])
    ranges = drawn.select(*[c.alias(n) for n, c in forest.cell_ranges(sizes).items()], "weights", "sums")
    cells = by_cell.transform(ranges).select(FEATURES, "weights", "sums").persist()
    # of several trees every one sees a third of the inputs at a node, as "auto" means for a forest
    one = {**spec.params, "numTrees": 1, "featureSubsetStrategy": "onethird"}
    tree = estimator(replace(spec, params=one)).setWeightCol("weight")
    try:
        model = forest.fit_trees(cells, tree, whole)
    finally:
        cells.unpersist()
    return PipelineModel([*steps, model])


def fit_counts(
    coded: DataFrame, by_cell: PipelineModel, sizes: dict[str, int], spec: ModelSpec, whole: RandomForestClassifier | GBTClassifier
) -> RandomForestClassificationModel | GBTClassificationModel | None:
    """The model of classes from (code, label) of the training rows, which are counted once (action).

    None where there are too many cells for the number of rows, or labels that are no classes.
    """
    counted = coded.groupBy("code", LABEL).agg(F.count(F.lit(1)).alias("n")).persist()
    try:
        is_class = (F.col(LABEL) >= 0) & (F.col(LABEL) < MOST_CLASSES) & (F.col(LABEL) == F.floor(LABEL))
        seen = counted.agg(
            F.count(F.lit(1)).alias("cells"), F.sum("n").alias("n"), F.max(LABEL).alias("last"), F.every(is_class).alias("fits")
        ).first()
        if not seen["fits"] or seen["n"] < forest.ROWS_PER_COUNT * seen["cells"]:
            return None
        # in a fixed order, so that draws and sums are the same whenever a part is made again
        parts = max(coded.sparkSession.sparkContext.defaultParallelism, 1 + seen["cells"] // forest.CELLS_PER_TASK)
        dealt = counted.repartition(parts, "code", LABEL).sortWithinPartitions("code", LABEL)
        weights = [F.col("n").cast("double").alias("weight")]
        if isinstance(whole, RandomForestClassifier):
            drawn = forest.drawn_counts(dealt, whole.getNumTrees(), whole.getSeed())
            dealt, weights = drawn, [F.col(c) for c in drawn.columns if c not in dealt.columns]
        classes = {"ml_attr": {"type": "nominal", "num_vals": int(seen["last"]) + 1}}
        ranges = dealt.select(
            *[c.alias(name) for name, c in forest.cell_ranges(sizes).items()], F.col(LABEL).alias(LABEL, metadata=classes), *weights
        )
        cells = by_cell.transform(ranges).select(FEATURES, *ranges.columns[len(sizes) :]).persist()
        try:
            if not isinstance(whole, RandomForestClassifier):
                return estimator(spec).setWeightCol("weight").fit(cells)
            # of several trees every one sees the square root of the inputs at a node; rows are drawn already
            one = {**spec.params, "numTrees": 1, "featureSubsetStrategy": "sqrt", "bootstrap": False}
            tree = estimator(replace(spec, params=one)).setWeightCol("weight")
            return forest.fit_trees(cells, tree, whole)
        finally:
            cells.unpersist()
    finally:
        counted.unpersist()


def evaluate(scored: DataFrame, spec: ModelSpec, n: str | None = None) -> DataFrame:
    """One row of metrics for scored rows; ``n`` names the number of rows that a row of classes stands for."""
    if spec.task != "classification":
        return regression_metrics(scored)
    table = classification_metrics(scored, positive=1.0, n=n)
    if "probability" in scored.columns:
        chance = scored.withColumn("chance", vector_to_array("probability")[1])
        table = table.withColumn("auc", auc(chance, "chance", F.col(LABEL) == 1.0, n).scalar())
    return table


def evaluated(model: PipelineModel, rows: DataFrame, spec: ModelSpec) -> DataFrame:
    """One row of metrics for rows that are not scored yet (action).

    A model of cells predicts the same for all rows of a cell, so they are counted per class and scored once.
    """
    by_row = [s for s in model.stages if isinstance(s, BY_ROW)]
    ranges = [name for s in by_row if isinstance(s, Bucketizer) for name in s.getOutputCols()]
    if spec.task != "classification" or not ranges:
        return one_row(evaluate(model.transform(rows), spec))
    inputs = ranges + [name for s in by_row if isinstance(s, StringIndexerModel) for name in s.getOutputCols()]
    cells = PipelineModel(by_row).transform(rows).groupBy(LABEL, *inputs).agg(F.count(F.lit(1)).alias("n"))
    scored = PipelineModel([s for s in model.stages if s not in by_row]).transform(cells)
    # metrics pass over the cells several times, and a task costs more than its few cells
    kept = (
        scored.select(LABEL, "n", *[c for c in (PREDICTION, "probability") if c in scored.columns])
        .coalesce(rows.sparkSession.sparkContext.defaultParallelism)
        .persist()
    )
    try:
        return one_row(evaluate(kept, spec, "n"))
    finally:
        kept.unpersist()


def train_eval(df: DataFrame, spec: ModelSpec) -> DataFrame:
    """Train one model and return its test metrics as one row (action).

    Plain linear regression comes from one aggregate (``operators/linear.py``).
    """
    fitted = fit_linear(df, spec) if is_plain_linear(spec) else None
    if fitted is not None:
        found = fitted.metrics()
        return df.sparkSession.createDataFrame([(found["rmse"], found["r2"])], "rmse double, r2 double")
    with prepare(df, spec) as split:
        return evaluated(fit(split, spec), split.test, spec)


def one_row(table: DataFrame) -> DataFrame:
    """Compute a one-row table now, so that the rows behind it can be released."""
    return table.sparkSession.createDataFrame(table.take(1), table.schema)


def baseline_model(
    df: DataFrame, target: str, key: str, task: str = "auto", **params
) -> DataFrame:
    """Random forest on all other columns with default preparation (action)."""
    if target not in df.columns:
        raise ValueError(f"target column {target!r} not found")
    if task == "auto":
        task = infer_task_type(df, target).first()["task_type"]
    features = df.drop(target, key)
    numeric = tuple(numeric_columns(features))
    categorical = tuple(c for c, kind in features.dtypes if kind in ("string", "boolean"))
    rows = df
    if task == "classification" and dict(df.dtypes)[target] in ("string", "boolean"):
        rows = StringIndexer(inputCol="__target", outputCol="__index", handleInvalid="skip").fit(
            df.select(F.col(target).cast("string").alias("__target"))
        ).transform(df.withColumn("__target", F.col(target).cast("string")))
        rows = rows.withColumn(target, F.col("__index")).drop("__target", "__index")
    spec = ModelSpec(
        target, key, numeric, categorical, "random_forest", task,
        params={**FOREST, **params},
    )
    return train_eval(rows, spec).withColumn("task_type", F.lit(task))


def compare_models(df: DataFrame, specs: dict[str, ModelSpec], metric: str) -> DataFrame:
    """Same split, several models, ranked by a metric with fit and score time (action)."""
    first = next(iter(specs.values()))
    spark = df.sparkSession
    rows = []
    with prepare(df, first) as split:
        for name, spec in specs.items():
            started = time.perf_counter()
            model = fit(split, spec)
            fitted = time.perf_counter()
            result = evaluated(model, split.test, spec).first()
            rows.append(
                (name, float(result[metric]), fitted - started, time.perf_counter() - fitted)
            )
    table = spark.createDataFrame(
        rows, f"model string, {metric} double, fit_seconds double, score_seconds double"
    )
    order = F.col(metric).asc() if metric == "rmse" else F.col(metric).desc()
    return table.withColumn("place", F.row_number().over(Window.orderBy(order, "model")))


def ranked(rows: DataFrame, seed: int = SEED) -> DataFrame:
    """Number all rows from 0 in a random order, as the long column ``__rank``.

    The order is that of a seeded hash of the whole row and the number of its
    copy, so it does not depend on how the rows are stored or dealt out, and
    copies of one row are spread as well. Rows are numbered within buckets of
    the hash; offsets come from the bucket counts.
    """
    columns = rows.columns
    copies = rows.groupBy(*columns).agg(F.count(F.lit(1)).alias("__n"))
    blocks = copies.withColumn("__block", F.explode(F.sequence(F.lit(0), F.expr(f"(__n - 1) div {COPIES}"))))
    # a row with very many copies is dealt out by block before the copies are made
    dealt = blocks.repartition(*columns, "__block")
    first = F.col("__block") * COPIES
    each = F.sequence(first, F.least(first + COPIES, F.col("__n")) - 1)
    single = dealt.withColumn("__copy", F.explode(each)).withColumn(
        "__hash", F.xxhash64(F.lit(seed), *columns, "__copy")
    )
    placed = single.withColumn("__bucket", F.shiftright("__hash", 64 - BUCKET_BITS).cast("int"))
    counts = placed.groupBy("__bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__offset"))
    inside = Window.partitionBy("__bucket").orderBy("__hash", *columns, "__copy")
    numbered = attach(placed, offsets, ["__bucket"], few=True)
    return numbered.select(*columns, (F.col("__offset") + F.row_number().over(inside) - 1).alias("__rank"))


def with_shifted(numbered: DataFrame, column: str, n: int, seed: int) -> DataFrame:
    """Rows numbered by ``ranked`` with the column's value of the row some places on."""
    shift = 1 + np.random.default_rng(seed).integers(n - 1) if n > 1 else 0
    moved = numbered.select(
        F.pmod(F.col("__rank") - F.lit(int(shift)), F.lit(max(n, 1))).alias("__rank"), F.col(column).alias("__moved")
    )
    joined = numbered.join(moved, "__rank").withColumn(column, F.col("__moved"))
    return joined.select(*[c for c in numbered.columns if c != "__rank"])


def permuted(rows: DataFrame, column: str, seed: int = SEED) -> DataFrame:
    """Shuffle one column against the others over the whole table (action: counts the rows).

    Rows are numbered in a seeded random order, and each takes the value of the
    row a random number of places further on. Every value is used exactly once,
    no row keeps its own, and the result depends on the rows and the seed only.
    """
    return with_shifted(ranked(rows, seed), column, rows.count(), seed)


def feature_importance(df: DataFrame, spec: ModelSpec) -> DataFrame:
    """Forest importance against permutation importance, with ranks and gap (action).

    Permutation importance is the loss of accuracy (or R2) on test rows when
    one feature is shuffled.
    """
    if spec.categorical:
        raise ValueError("feature importance takes numeric features")
    metric = "accuracy" if spec.task == "classification" else "r2"
    with prepare(df, spec) as split:
        model = fit(split, spec)
        test = split.test.select(LABEL, *spec.numeric)

        def score(rows: DataFrame) -> float:
            if spec.task == "classification":
                return float(classification_metrics(model.transform(rows)).first()[metric])
            return float(grouped_r2(rows, model, list(spec.numeric)).first()[metric])

        whole, n = score(test), test.count()
        numbered = ranked(test).persist()
        built_in = model.stages[-1].featureImportances.toArray()
        rows = [
            (name, float(built_in[i]), whole - score(with_shifted(numbered, name, n, SEED + i)))
            for i, name in enumerate(spec.numeric)
        ]
        numbered.unpersist()
    table = df.sparkSession.createDataFrame(
        rows, "feature string, forest_importance double, permutation_importance double"
    )
    by_forest = Window.orderBy(F.col("forest_importance").desc(), "feature")
    by_shuffle = Window.orderBy(F.col("permutation_importance").desc(), "feature")
    return (
        table.withColumn("forest_rank", F.row_number().over(by_forest))
        .withColumn("permutation_rank", F.row_number().over(by_shuffle))
        .withColumn("rank_gap", F.abs(F.col("forest_rank") - F.col("permutation_rank")))
    )


def feature_group_ablation(
    df: DataFrame, spec: ModelSpec, groups: dict[str, list[str]], metric: str
) -> DataFrame:
    """Score with each feature group alone and with each removed (action).

    For plain linear regression every score is a sub-matrix of one aggregate.
    """
    fitted = fit_linear(df, spec) if is_plain_linear(spec) else None
    split = prepare(df, spec) if fitted is None else None

    def score(kept: list[str]) -> float | None:
        if fitted is not None:
            return fitted.metrics(kept)[metric]
        part = ModelSpec(
            spec.target, spec.key,
            tuple(c for c in spec.numeric if c in kept),
            tuple(c for c in spec.categorical if c in kept),
            spec.model, spec.task, spec.train_share, spec.balanced, spec.params,
        )
        model = fit(split, part)
        scored = model.transform(split.test)
        return float(evaluate(scored, part).first()[metric])

    everything = [c for members in groups.values() for c in members]
    whole = score(everything)
    rows = []
    for name, members in groups.items():
        rest = [c for c in everything if c not in members]
        rows.append((name, score(members), score(rest) if rest else None, whole))
    if split is not None:
        split.release()
    table = df.sparkSession.createDataFrame(
        rows, "feature_group string, alone double, removed double, all_features double"
    )
    table = table.withColumn("loss_when_removed", F.col("all_features") - F.col("removed"))
    order = Window.orderBy(F.col("loss_when_removed").desc_nulls_last(), "feature_group")
    return table.withColumn("place", F.row_number().over(order))


def linear_terms(
    rows: DataFrame, coefficients: dict[str, float], means: dict[str, Column] | None = None
) -> dict[str, Column]:
    """Contribution coefficient x (value - mean) of each feature of a linear model."""
    if means is None:
        whole = rows.agg(
            F.struct(*[F.avg(F.col(c).cast("double")).alias(c) for c in coefficients])
        ).scalar()
        means = {c: whole[c] for c in coefficients}
    return {
        c: F.lit(float(w)) * (F.col(c).cast("double") - means[c])
        for c, w in coefficients.items()
    }


def local_contributions(rows: DataFrame, coefficients: dict[str, float]) -> DataFrame:
    """Add ``contrib_<feature>`` per row and their sum."""
    terms = linear_terms(rows, coefficients)
    return rows.withColumns(
        {
            **{f"contrib_{c}": term for c, term in terms.items()},
            "contrib_total": total(list(terms.values())),
        }
    )


def global_contributions(explained: DataFrame, features: list[str]) -> DataFrame:
    """Mean absolute contribution per feature."""
    row = explained.agg(*[F.avg(F.abs(f"contrib_{c}")).alias(c) for c in features])
    return row.unpivot([], features, "feature", "mean_abs_contribution")


def coefficients_of(model: PipelineModel, spec: ModelSpec) -> dict[str, float]:
    """Per-unit coefficients of a fitted linear model over numeric features."""
    weights = model.stages[-1].coefficients.toArray()
    scaler = next(s for s in model.stages if s.__class__.__name__ == "StandardScalerModel")
    spread = scaler.std.toArray()
    return {
        name: float(weights[i] / spread[i]) if spread[i] else 0.0
        for i, name in enumerate(spec.numeric)
    }


def counterfactuals(
    rows: DataFrame,
    model: PipelineModel,
    edits: list[dict[str, float]],
    key: str,
    wanted: float,
) -> DataFrame:
    """Fewest feature edits that give the wanted prediction, per row (action).

    ``key`` must identify a row. ``edits`` is a fixed list of feature values.
    They are tried level by level, those that change one feature first; rows
    that have flipped leave by an anti join, so later and larger edits meet
    only what is left. Ties go to the edit listed first. Levels are written to
    the shared folder; nothing stays in memory.
    """
    spark = rows.sparkSession
    path = scratch_path(spark, "counterfactuals")
    names = sorted({name for edit in edits for name in edit})
    kind = dict(rows.dtypes)[key]
    result = f"{key} {kind}, edit int, changes int"
    written: list[str] = []
    for changes in sorted({len(edit) for edit in edits}):
        level = [(i, edit) for i, edit in enumerate(edits) if len(edit) == changes]
        options = F.array(
            *[
                F.struct(
                    F.lit(i).alias("edit"),
                    *[
                        F.lit(float(edit[n]) if n in edit else None).cast("double").alias(n)
                        for n in names
                    ],
                )
                for i, edit in level
            ]
        )
        left = rows
        if written:
            left = rows.join(spark.read.schema(result).parquet(*written).select(key), key, "left_anti")
        tried = left.withColumn("option", F.explode(options)).withColumns(
            {n: F.coalesce(F.col("option")[n], F.col(n).cast("double")) for n in names}
        )
        flipped = model.transform(tried).where(F.col(PREDICTION) == wanted)
        found = flipped.groupBy(key).agg(
            F.min(F.col("option")["edit"]).alias("edit"), F.lit(changes).alias("changes")
        )
        written.append(f"{path}/level={changes}")
        found.write.parquet(written[-1])
    if not written:
        return spark.createDataFrame([], result)
    return spark.read.schema(result).parquet(*written)
