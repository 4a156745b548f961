"""Model tables, evaluation by folds, selection and evolutionary search on MLlib."""

from __future__ import annotations

import itertools
import time
from collections.abc import Callable, Sequence
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark.ml import Estimator, Model, Pipeline
from pyspark.ml.classification import (DecisionTreeClassifier, GBTClassifier, LinearSVC, LogisticRegression,
                                       MultilayerPerceptronClassifier, RandomForestClassifier)
from pyspark.ml.feature import PCA, Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import (DecisionTreeRegressor, FMRegressor, GBTRegressor,
                                   RandomForestRegressor)
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.operators.elastic_net import ElasticNetCV, elastic_net_cv, impute_medians
from evalspark.operators.evaluation import evaluation_rows
from evalspark.operators.features import cap_selection
from evalspark.operators.linear import fold_coefficients, linear_prediction
from evalspark.operators.ordering import key_join
from evalspark.operators.search import Space, group_losses, known_metric, mean_losses
from evalspark.operators.search import generations as search
from evalspark.operators.splits import group_kfold, subgroup_plan
from evalspark.session import durable

# Penalty grid of the linear selector.
SELECTOR_ALPHAS = tuple(10 ** (-5 + 4 * i / 11) for i in range(12))
SELECTOR_L1_RATIOS = (0.1, 0.5, 0.9, 1.0)


def regression_models(seed: int = 42, trees: int = 400) -> dict[str, Estimator]:
    return {
        "ElasticNetCV": ElasticNetCV(seed=seed),
        "Random Forest": RandomForestRegressor(numTrees=trees, seed=seed),
        "Gradient Boosting": GBTRegressor(maxIter=max(5, trees // 10), seed=seed),
        "Decision Tree": DecisionTreeRegressor(seed=seed),
        "Factorization Machine": FMRegressor(factorSize=4, stepSize=0.01, maxIter=max(5, trees // 10), seed=seed),
    }


def classification_models(n_features: int, n_classes: int = 2, seed: int = 42, trees: int = 400) -> dict[str, Estimator]:
    return {
        "Logistic Regression": LogisticRegression(regParam=0.01),
        "Random Forest": RandomForestClassifier(numTrees=trees, seed=seed),
        "Gradient Boosting": GBTClassifier(maxIter=max(5, trees // 10), seed=seed),
        "Linear SVM": LinearSVC(regParam=0.01),
        "Decision Tree": DecisionTreeClassifier(seed=seed),
        "MLP": MultilayerPerceptronClassifier(layers=[n_features, 16, n_classes], seed=seed, maxIter=max(20, trees // 4)),
    }


def as_vectors(df: DataFrame, features: str, target: str) -> DataFrame:
    """MLlib columns ``features`` and ``label`` from an array column."""
    return df.withColumns({"features": array_to_vector(F.col(features).cast("array<double>")), "label": F.col(target).cast("double")})


def table_stages(columns: Sequence[str], model: Estimator) -> Pipeline:
    """Median imputation, assembly, scaling and a model for a table with one column per feature."""
    filled = [f"{c}__f" for c in columns]
    return Pipeline(stages=[Imputer(strategy="median", inputCols=list(columns), outputCols=filled),
                            VectorAssembler(inputCols=filled, outputCol="_raw"),
                            StandardScaler(inputCol="_raw", outputCol="features", withMean=True), model])


def score_column(scored: DataFrame) -> Column:
    """Probability of class 1, else the decision value, else the prediction."""
    if "probability" in scored.columns:
        return vector_to_array("probability")[1]
    if "rawPrediction" in scored.columns:
        return vector_to_array("rawPrediction")[1]
    return F.col("prediction")


def predict(model: Model, df: DataFrame, keep: Sequence[str]) -> DataFrame:
    out = model.transform(df)
    return out.select(*keep, F.col("label").alias("observed"), score_column(out).alias("predicted"))


def evaluate_model(name: str, estimator: Estimator, df: DataFrame, fold: str, row_id: str, classification: bool = False,
                   parallelism: int = 4) -> DataFrame:
    """Fold models on train rows, a refit, and one prediction table: ``part`` is cv, train or test.

    ``df`` has features, label, split and a fold number; fits are submitted in parallel and each runs distributed. A
    failing model yields one row with its error text instead of stopping the run.
    """
    spark = df.sparkSession
    keep = [row_id, fold, "split"]
    train, test = df.where("split = 'train'"), df.where("split = 'test'")
    try:
        started = time.time()
        folds = sorted(r[0] for r in train.select(fold).distinct().collect())
        with ThreadPool(parallelism) as pool:
            fits = pool.map(lambda f: estimator.fit(train if f is None else train.where(F.col(fold) != f)), [*folds, None])
        parts = [predict(m, train.where(F.col(fold) == f), keep).withColumn("part", F.lit("cv")) for f, m in zip(folds, fits)]
        parts.append(predict(fits[-1], train, keep).withColumn("part", F.lit("train")))
        parts.append(predict(fits[-1], test, keep).withColumn("part", F.lit("test")))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out.withColumns({"model": F.lit(name), "fit_seconds": F.lit(time.time() - started),
                                "error": F.lit(None).cast("string")})
    except Exception as exc:  # the stage reports the failure and the run goes on
        schema = df.select(*keep).schema.simpleString()[7:-1]
        return spark.createDataFrame([], schema.replace(":", " ") + ", observed double, predicted double, part string").unionByName(
            spark.createDataFrame([(name, str(exc))], "model string, error string"), allowMissingColumns=True).withColumn(
            "fit_seconds", F.lit(None).cast("double"))


def model_report(pred: DataFrame, fold: str, classification: bool = False, primary_metric: str | None = None) -> DataFrame:
    """One row per model: all metrics of ``evaluation_rows``, row counts, timing and error text (a failed model has nothing else)."""
    ok = pred.where("error IS NULL")
    rows = evaluation_rows(ok, ["model"], fold, primary_metric or ("roc_auc" if classification else "rmse"), classification)
    size = lambda part: F.count_if(F.col("part") == part).alias(f"n_{part}")
    out = pred.groupBy("model").agg(F.max("error").alias("error"), F.max("fit_seconds").alias("elapsed_seconds"), size("train"), size("test"))
    return out.join(rows, "model", "left")


# --- selection ---------------------------------------------------------------------------------------------------

def elastic_net_selection(df: DataFrame, fold: str, folds: int, alphas: Sequence[float] = SELECTOR_ALPHAS,
                          l1_ratios: Sequence[float] = SELECTOR_L1_RATIOS, threshold: float = 1e-10) -> DataFrame:
    """Scaled coefficients of the best elastic net on median-imputed features, capped at a tenth of the train rows.

    ``fold`` numbers are taken modulo ``folds``. The whole grid costs one pass over the rows.
    """
    train = df.where("split = 'train'").select(F.pmod(F.col(fold), F.lit(folds)).alias("_fold"), vector_to_array("features").alias("_x"), F.col("label").alias("_y"))
    train = train.withColumn("_all", F.lit(0))
    best = elastic_net_cv(impute_medians(train, train, ["_all"], "_x"), ["_all"], "_fold", "_x", "_y", alphas, l1_ratios).first()
    return _selected(train, list(best["scaled"]), "elastic_net", threshold)


def forest_selection(df: DataFrame, trees: int = 100, seed: int = 42) -> DataFrame:
    """Fallback selection by forest importance."""
    train = df.where("split = 'train'")
    best = RandomForestRegressor(numTrees=trees, seed=seed).fit(train)
    return _selected(train, best.featureImportances.toArray().tolist(), "random_forest", 0.0)


def _selected(train: DataFrame, values: list[float], source: str, threshold: float) -> DataFrame:
    spark = train.sparkSession
    coef = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "feature int, coefficient double")
    n = train.agg(F.count(F.lit(1)).alias("_n"))
    c = coef.crossJoin(n).withColumns({"magnitude": F.abs("coefficient"), "_all": F.lit(0)})  # one-row side
    kept = cap_selection(c, ["_all"], "_n", threshold=threshold).select("feature", "selection_rank")
    return coef.join(kept, "feature", "left").withColumns({"source": F.lit(source), "is_selected": F.col("selection_rank").isNotNull()})


def select_features(df: DataFrame, fold: str, folds: int, selector: str = "elastic_net", **kwargs) -> DataFrame:
    """The selection by the named ``selector``: ``elastic_net`` or ``random_forest``; a failing fit raises."""
    if selector == "elastic_net":
        return elastic_net_selection(df, fold, folds, **kwargs)
    if selector == "random_forest":
        return forest_selection(df, **kwargs)
    raise ValueError(f"unknown selector {selector!r}")


def principal_components(df: DataFrame, k: int = 2) -> DataFrame:
    model = PCA(k=k, inputCol="features", outputCol="_pc").fit(df)
    return model.transform(df).withColumn("components", vector_to_array("_pc")).drop("_pc")


# --- evolutionary search -------------------------------------------------------------------------------------------

def evolve(df: DataFrame, build: Callable[[dict], Estimator], space: Space, fold: str, population: int = 16,
           generations: int = 12, elites: int = 2, mutation: float = 0.35, seed: int = 42, parallelism: int = 8, metric: str = "rmse") -> DataFrame:
    """Search history over any MLlib estimators (``loss``: mean fold loss on train rows by ``metric``).

    The fits of a generation's new individuals run as parallel Spark jobs on one checkpointed frame, and one aggregate
    scores all of them. ``search.evolve_elastic_net`` needs no job per fit.
    """
    known_metric(metric)
    train = durable(df.where("split = 'train'"))
    folds = sorted(r[0] for r in train.select(fold).distinct().collect())

    def losses(individuals: list[dict]) -> list[float]:
        jobs = list(itertools.product(range(len(individuals)), folds))
        with ThreadPool(parallelism) as pool:
            fits = pool.map(lambda job: build(individuals[job[0]]).fit(train.where(F.col(fold) != job[1])), jobs)
        parts = [predict(m, train.where(F.col(fold) == f), [fold]).withColumn("candidate", F.lit(c)) for (c, f), m in zip(jobs, fits)]
        return mean_losses(group_losses(reduce(DataFrame.unionByName, parts), ["candidate", fold], metric), len(individuals), len(folds))

    return search(df.sparkSession, losses, space, population, generations, elites, mutation, seed)


# --- grouped stack with global fallback ----------------------------------------------------------------------------

def grouped_stack(df: DataFrame, group: str, key: str, row_id: str, features: str, target: str, max_folds: int = 5,
                  alphas: Sequence[float] = (0.1, 1.0, 10.0), min_rows: int = 30, min_keys: int = 20) -> tuple[DataFrame, DataFrame]:
    """(predictions, group manifest): out-of-fold predictions of a global and of per-group models, group where viable.

    Base learner: ridge from moments, so all groups and folds come from one pass over the rows. Folds keep equal keys
    together. Test rows use the full fits.
    """
    train, test = df.where("split = 'train'"), df.where("split = 'test'")
    n_test = test.groupBy(group).agg(F.count(F.lit(1)).alias("test_rows"))
    plan = subgroup_plan(train, [group], key, max_folds, min_rows, min_keys)
    manifest = plan.join(n_test, group, "left").fillna(0, ["test_rows"])
    base = train.withColumn("_all", F.lit("all"))
    folded = group_kfold(base, ["_all"], key, max_folds).withColumnRenamed("fold", "gf").drop("folds")
    folded = durable(group_kfold(folded, [group], key, max_folds).withColumnRenamed("fold", "lf").drop("folds"))
    viable = plan.where("status = 'trained'").select(group)
    glob = fold_coefficients(folded, ["_all"], "gf", features, target, alphas).drop("alpha")
    local = fold_coefficients(folded.join(viable, group, "left_semi"), [group], "lf", features, target, alphas).drop("alpha")
    fit = durable(glob.withColumn("scope", F.lit("global")).withColumn(group, F.lit(None).cast("string")).select("scope", group, "fold", "coef")
                  .unionByName(local.withColumn("scope", F.lit("group")).select("scope", F.col(group).cast("string").alias(group), "fold", "coef")))

    def scored(rows: DataFrame, global_fold, local_fold) -> DataFrame:
        g = fit.where("scope = 'global'").select(F.col("fold").alias("_gf"), F.col("coef").alias("_gc"))
        one = fit.where("scope = 'group'").select(F.col(group).alias("_lg"), F.col("fold").alias("_lf"), F.col("coef").alias("_lc"))
        j = rows.withColumns({"_a": global_fold, "_b": local_fold})
        j = j.join(F.broadcast(g), F.col("_a") == F.col("_gf"))  # max_folds + 1 rows
        j = j.join(one, (F.col(group).cast("string") == F.col("_lg")) & (F.col("_b") == F.col("_lf")), "left")
        gp, lp = linear_prediction(features, "_gc"), F.when(F.col("_lc").isNotNull(), linear_prediction(features, "_lc"))
        return j.select(row_id, group, "split", F.col(target).cast("double").alias("observed"), gp.alias("global_pred"),
                        lp.alias("group_pred")).withColumns({
                            "stack_pred": F.coalesce("group_pred", "global_pred"),
                            "group_available": F.col("group_pred").isNotNull().cast("int")})

    full = F.lit(-1).cast("long")
    return scored(folded, F.col("gf"), F.col("lf")).unionByName(scored(test, full, full)), manifest


def meta_features(stacked: DataFrame, aux: DataFrame, row_id: str, aux_columns: Sequence[str]) -> DataFrame:
    """Inputs of the meta model: stacked prediction, availability flag and auxiliary columns."""
    j = key_join(stacked, aux, [row_id])
    cols = ["stack_pred", "group_available", *aux_columns]
    return j.withColumns({"features": array_to_vector(F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in cols])),
                          "label": F.col("observed")})


