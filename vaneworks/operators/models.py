"""Classifiers on pooled window features: fit, score, search. Training is MLlib's, which works on partitions."""

from __future__ import annotations

import math
import random
from collections.abc import Callable, Sequence
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vaneworks.functions.vectors import above
from vaneworks.operators.history import stopping_point
from vaneworks.operators.splits import random_split
from vaneworks.schema import ROW_ID, SERIES

# Search ranges (low, high) and whether they are drawn on a log scale.
SEARCH_RANGES = {
    "learning_rate": (1e-5, 1e-2, True),
    "weight_decay": (1e-6, 1e-3, True),
    "num_layers": (1, 4, False),
    "dropout": (0.1, 0.5, False),
}


def _assembler(features: Sequence[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="error")


def complete_rows(df: DataFrame, features: Sequence[str], label: str = "label") -> DataFrame:
    """Rows a model can be fitted on: no missing feature or label. The label becomes a double."""
    return df.na.drop(subset=[*features, label]).withColumn(label, F.col(label).cast("double"))


def fit_logistic(
    df: DataFrame, features: Sequence[str], label: str = "label", weight_decay: float = 1e-5, max_iter: int = 100
) -> PipelineModel:
    """Sigmoid output, cross-entropy loss with an L2 penalty of ``weight_decay``."""
    lr = LogisticRegression(
        featuresCol="features", labelCol=label, regParam=weight_decay, elasticNetParam=0.0, maxIter=max_iter
    )
    return Pipeline(stages=[_assembler(features), lr]).fit(complete_rows(df, features, label))


def fit_boosted_trees(
    df: DataFrame,
    features: Sequence[str],
    label: str = "label",
    max_iter: int = 20,
    max_depth: int = 3,
    step_size: float = 0.1,
    seed: int = 42,
) -> PipelineModel:
    """Boosted-tree baseline on the same features."""
    gbt = GBTClassifier(
        featuresCol="features", labelCol=label, maxIter=max_iter, maxDepth=max_depth, stepSize=step_size, seed=seed
    )
    return Pipeline(stages=[_assembler(features), gbt]).fit(complete_rows(df, features, label))


def score(df: DataFrame, model: PipelineModel, threshold: float | None = None) -> DataFrame:
    """Adds ``p`` (probability of class 1) and, with a threshold, ``decision``; N rows in, N rows out.

    The model's own columns are dropped. A row with a missing feature keeps its place with a NULL score.
    """
    assembler = model.stages[0].copy()
    assembler.setHandleInvalid("keep")  # missing values become NaN and are told apart below
    columns = assembler.getInputCols()
    known = F.lit(True)
    for name in columns:
        known = known & F.col(name).isNotNull() & ~F.isnan(F.col(name).cast("double"))
    scored = PipelineModel([assembler, *model.stages[1:]]).transform(df)
    scored = scored.withColumn("p", F.when(known, vector_to_array("probability")[1]))
    if threshold is not None:
        scored = scored.withColumn("decision", above(F.col("p"), threshold))
    return scored.drop("features", "rawPrediction", "probability", "prediction")


def linear_coefficients(model: PipelineModel) -> dict[str, float]:
    """Weight per feature of a fitted logistic model, its constant under ``intercept``."""
    lr = model.stages[-1]
    weights = dict(zip(model.stages[0].getInputCols(), (float(w) for w in lr.coefficients.toArray())))
    return {**weights, "intercept": float(lr.intercept)}


def score_linear(df: DataFrame, coefficients: dict[str, float], threshold: float | None = None) -> DataFrame:
    """Score with exported weights as one arithmetic expression: no vectors, stays in generated code, streams."""
    margin = F.lit(float(coefficients.get("intercept", 0.0)))
    for name, weight in coefficients.items():
        if name != "intercept":
            margin = margin + F.lit(float(weight)) * F.col(name)
    scored = df.withColumn("p", F.lit(1.0) / (F.lit(1.0) + F.exp(-margin)))
    return scored.withColumn("decision", above(F.col("p"), threshold)) if threshold is not None else scored


def _tree_value(node, value: Callable[[int], Column]) -> Column:
    """The prediction of a regression tree below a node of the stored model, as nested conditions."""
    if node.subtreeDepth() == 0:
        return F.lit(float(node.prediction()))
    split = node.split()
    if not hasattr(split, "threshold"):
        raise ValueError("only splits of continuous features can be written out")
    below, above_it = (_tree_value(child, value) for child in (node.leftChild(), node.rightChild()))
    return F.when(value(split.featureIndex()) <= F.lit(float(split.threshold())), below).otherwise(above_it)


def compiled_score(model: PipelineModel, value: Callable[[str], Column]) -> Column:
    """The probability of class 1 of a fitted model as an expression of its inputs, ``value(name)``; NULL if one is missing.

    Both families become arithmetic and conditions, so rows, array elements and streams are scored in generated code, without
    vectors or model objects on the executors.
    """
    names, fitted = model.stages[0].getInputCols(), model.stages[-1]
    values = [value(name) for name in names]
    known = F.lit(True)
    for x in values:
        known = known & x.isNotNull() & ~F.isnan(x.cast("double"))
    if hasattr(fitted, "coefficients"):
        margin = F.lit(float(fitted.intercept))
        for x, weight in zip(values, fitted.coefficients.toArray()):
            margin = margin + F.lit(float(weight)) * x
    elif hasattr(fitted, "treeWeights"):
        margin = F.lit(0.0)
        for tree, weight in zip(fitted.trees, fitted.treeWeights):
            margin = margin + F.lit(float(weight)) * _tree_value(tree._java_obj.rootNode(), lambda i: values[i])
        margin = 2 * margin
    else:
        raise ValueError(f"a {type(fitted).__name__} cannot be written out")
    return F.when(known, F.lit(1.0) / (F.lit(1.0) + F.exp(-margin)))


def score_compiled(df: DataFrame, model: PipelineModel, threshold: float | None = None) -> DataFrame:
    """As ``score``, by ``compiled_score``."""
    scored = df.withColumn("p", compiled_score(model, F.col))
    return scored.withColumn("decision", above(F.col("p"), threshold)) if threshold is not None else scored


def draw_trials(n: int, seed: int = 42) -> list[dict[str, float]]:
    """Reproducible draws from the search ranges."""
    rng = random.Random(seed)
    trials = []
    for _ in range(n):
        drawn = {}
        for name, (low, high, logarithmic) in SEARCH_RANGES.items():
            if logarithmic:
                drawn[name] = math.exp(rng.uniform(math.log(low), math.log(high)))
            elif isinstance(low, int):
                drawn[name] = rng.randint(low, high)
            else:
                drawn[name] = rng.uniform(low, high)
        trials.append(drawn)
    return trials


def loss_gradient(
    df: DataFrame, coefficients: dict[str, float], label: str = "label", weight_decay: float = 1e-5
) -> dict[str, float]:
    """Slope of the penalised loss at exported weights, per weight in units of its feature's deviation: near 0 at the optimum."""
    names = [name for name in coefficients if name != "intercept"]
    rows = score_linear(complete_rows(df, names, label), coefficients)
    error = F.col("p") - F.col(label)
    found = rows.agg(
        F.avg(error).alias("intercept"),
        *[F.avg(error * F.col(n)).alias(f"g_{n}") for n in names],
        *[F.stddev_samp(n).alias(f"s_{n}") for n in names],
    ).first()
    slopes = {"intercept": found["intercept"]}
    for n in names:
        deviation = found[f"s_{n}"] or 0.0
        slopes[n] = found[f"g_{n}"] / deviation + weight_decay * coefficients[n] * deviation if deviation else 0.0
    return slopes


#: Settings that each family uses, with what they are without a search.
USED = {"logistic": {"weight_decay": 1e-5, "dropout": 0.0}, "trees": {"num_layers": 3, "learning_rate": 0.01}}


def estimator(family: str, setting: dict[str, float], max_iter: int, label: str = "label", seed: int = 42):
    """The MLlib estimator of a drawn setting: the weight decay is the L2/L1 penalty of the logistic model and the dropout its L1
    share; the trees use the layers as depth and the learning rate, scaled to boosting steps, as step size."""
    if family not in USED:
        raise ValueError(f"unknown family {family!r}")
    value = USED[family] | setting
    if family == "logistic":
        return LogisticRegression(labelCol=label, maxIter=max_iter, regParam=value["weight_decay"], elasticNetParam=value["dropout"])
    step = min(1.0, 10 * value["learning_rate"])
    return GBTClassifier(labelCol=label, maxIter=max_iter, maxDepth=int(value["num_layers"]), stepSize=step, seed=seed)


def rungs(trials: int, max_iter: int, keep: int) -> list[int]:
    """Iterations of the rounds of successive halving, the last one ``max_iter``; one round with ``keep`` 1."""
    levels = [max_iter]
    while keep > 1 and trials > 1 and levels[0] // keep >= 1:
        levels.insert(0, levels[0] // keep)
        trials = -(-trials // keep)
    return levels


def search(
    df: DataFrame,
    features: Sequence[str],
    label: str = "label",
    family: str = "logistic",
    trials: int = 20,
    train_ratio: float = 0.8,
    max_iter: int = 20,
    seed: int = 42,
    ids: Sequence[str] = (SERIES, ROW_ID),
    parallelism: int = 4,
    keep_one_in: int = 1,
) -> tuple[PipelineModel, DataFrame]:
    """Random search that minimises the validation log loss, ``parallelism`` trials at a time on one cached input.

    A ``split`` column says what is ``train`` and ``val`` (other rows, as those in the gap of a head split, are used for
    neither); without one the rows are split by a hash of ``ids``, whatever their partitions. With ``keep_one_in`` above 1
    the trials run in rounds of growing iterations (successive halving): the best share of a round goes on to the next, and
    those of the last round are fitted as without it. Returns the best model, fitted on train and validation rows, and one
    row per trial: ``trial``, the parameters that the family uses (see ``estimator``), ``iterations`` it was given,
    ``val_loss`` after these, and ``is_best`` (of equal losses the first trial). The answer does not depend on the order in
    which trials end.
    """
    drawn = [{name: t[name] for name in USED[family]} for t in draw_trials(trials, seed)] if family in USED else estimator(family, {}, 1)
    if "split" not in df.columns:
        df = random_split(df, ids, train_ratio, 1 - train_ratio, seed)
        df = df.withColumn("split", F.when(F.col("split") == "train", "train").otherwise("val"))
    evaluator = MulticlassClassificationEvaluator(labelCol=label, metricName="logLoss", probabilityCol="probability")
    rows = _assembled(df, features, label).persist()
    losses: dict[int, float] = {}
    given: dict[int, int] = {}
    try:
        train, held_out = rows.where(F.col("split") == "train"), rows.where(F.col("split") == "val")
        rows.count()  # trials that start together would each fill the cache
        alive = list(range(trials))
        for round_, iterations in enumerate(levels := rungs(trials, max_iter, keep_one_in)):

            def tried(i: int, iterations: int = iterations) -> float:
                return float(evaluator.evaluate(estimator(family, drawn[i], iterations, label, seed).fit(train).transform(held_out)))

            with ThreadPool(max(1, min(parallelism, len(alive)))) as pool:
                found = pool.map(inheritable_thread_target(df.sparkSession)(tried), alive, chunksize=1)
            losses |= dict(zip(alive, found))
            given |= dict.fromkeys(alive, iterations)
            if round_ + 1 < len(levels):
                alive = sorted(alive, key=lambda i: (losses[i], i))[: -(-len(alive) // keep_one_in)]
        best = min(alive, key=lambda i: (losses[i], i))
        model = PipelineModel([_assembler(features), estimator(family, drawn[best], max_iter, label, seed).fit(rows)])
    finally:
        rows.unpersist()
    names = list(USED[family])
    table = df.sparkSession.createDataFrame(
        [(i, family, *[float(t[name]) for name in names], given[i], losses[i], i == best) for i, t in enumerate(drawn)],
        "trial int, family string, " + ", ".join(f"{name} double" for name in names) + ", iterations int, val_loss double, is_best boolean",
    )
    return model, table


def _assembled(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """features (a vector), label and split of the complete rows of train and validation."""
    complete = complete_rows(df, features, label).select(*features, label, "split").where(F.col("split").isin("train", "val"))
    return _assembler(features).transform(complete).select("features", label, "split")


def fit_epochs(
    df: DataFrame,
    features: Sequence[str],
    label: str = "label",
    family: str = "logistic",
    setting: dict[str, float] | None = None,
    max_iter: int = 100,
    epoch_iterations: int = 5,
    patience: int = 10,
    min_delta: float = 0.001,
    seed: int = 42,
    run: str | None = None,
) -> tuple[PipelineModel, DataFrame]:
    """Fit on the ``train`` rows of ``split`` epoch by epoch, watch the loss of the ``val`` rows, keep the best epoch's model.

    An epoch is ``epoch_iterations`` iterations of the logistic model, which goes on from the last epoch's weights, or one
    tree. The stopping rule is that of ``early_stopping``; without validation rows all iterations are made and the last
    state is kept. Returns the model and its history: run, epoch (from 1), train_loss and val_loss (mean log losses; NULL
    without rows).
    """
    setting, run = setting or {}, run or family
    rows = _assembled(df, features, label).persist()
    history: list[tuple[float | None, float | None]] = []

    def watched() -> list[float]:
        return [math.inf if v is None else v for _, v in history]

    try:
        train, held_out = rows.where(F.col("split") == "train"), rows.where(F.col("split") == "val")
        unseen = held_out.isEmpty()
        if family == "trees":
            fitted = estimator(family, setting, max_iter, label, seed).fit(train)
            # the loss of boosting is twice the log loss
            seen = [fitted.evaluateEachIteration(train), [] if unseen else fitted.evaluateEachIteration(held_out)]
            history = [(seen[0][i] / 2, None if unseen else seen[1][i] / 2) for i in range(len(seen[0]))]
            best, stop = stopping_point(watched(), patience, min_delta)
            history = history[: stop + 1] if stop >= 0 and not unseen else history
            if not unseen and 0 <= best < len(fitted.trees) - 1:
                fitted = estimator(family, setting, best + 1, label, seed).fit(train)  # the same first trees
        else:
            left, fitted, kept = max_iter, None, None
            while left > 0:
                est = estimator(family, setting, min(epoch_iterations, left), label, seed)
                if fitted is not None:
                    est._java_obj.setInitialModel(fitted._java_obj)  # not in the Python API
                fitted = est.fit(train)
                left -= epoch_iterations
                p = vector_to_array("probability")[F.col(label).cast("int")]
                means = fitted.transform(rows).groupBy("split").agg(F.avg(-F.log(F.greatest(p, F.lit(1e-15)))).alias("loss"))
                found = {r["split"]: r["loss"] for r in means.collect()}
                history.append((found.get("train"), found.get("val")))
                best, stop = stopping_point(watched(), patience, min_delta)
                if best == len(history) - 1 or unseen:
                    kept = fitted
                if stop >= 0 and not unseen:
                    break
            fitted = kept or fitted
    finally:
        rows.unpersist()
    table = df.sparkSession.createDataFrame(
        [(run, i + 1, t, v) for i, (t, v) in enumerate(history)], "run string, epoch int, train_loss double, val_loss double"
    )
    return PipelineModel([_assembler(features), fitted]), table


def objective_history(model: PipelineModel, run: str, df: DataFrame) -> DataFrame:
    """Training loss per iteration of a fitted logistic model as history rows (run, epoch, metric, value)."""
    losses = [float(v) for v in model.stages[-1].summary.objectiveHistory]
    return df.sparkSession.createDataFrame(
        [(run, i, "train_loss", v) for i, v in enumerate(losses)], "run string, epoch int, metric string, value double"
    )
