"""Purchase classifiers, purchase-count regressors, stacked models and their metrics.

Training uses ``pyspark.ml`` (distributed tree and linear learners); metrics
are plain DataFrame aggregates so they run on the executors and can be
checked against SQL.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shopweave.functions.core import md5_bucket
from shopweave.schemas import FEATURE_COLUMNS
from shopweave.session import stored, tasks_for

# Fixed model settings of the source job.
FOREST_SEED = 5043
FOREST_TREES = 32
FOREST_DEPTH = 4
MAX_CATEGORIES = 8
GBT_ITER = 10
LR_ITER = 10
LR_REG = 0.3
LR_ELASTIC_NET = 0.8
SAMPLE_FRACTION = 0.2


def assemble(df: DataFrame, cols: list[str] | None = None, out: str = "features") -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    cols = cols or FEATURE_COLUMNS
    cast = df.select("*", *[F.col(c).cast("double").alias(f"_{c}") for c in cols])
    v = VectorAssembler(inputCols=[f"_{c}" for c in cols], outputCol=out).transform(cast)
    return v.drop(*[f"_{c}" for c in cols])


KEYS = ["user_id", "shop_id"]


def hash_split(df: DataFrame, keys: list[str], train_pct: int = 80, salt: str = "") -> DataFrame:
    """Deterministic train/test flag from an md5 bucket of the key (independent of partitioning)."""
    b = md5_bucket(keys, 100, salt)
    return df.withColumn("bucket", b).withColumn("is_train", F.col("bucket") < train_pct)


def split_parts(df: DataFrame, keys: list[str], train_pct: int = 80, salt: str = "") -> tuple[DataFrame, DataFrame]:
    """(train, held out) by ``hash_split``: a row's side depends on its key alone, so the parts never overlap."""
    marked = hash_split(df, keys, train_pct, salt).drop("bucket")
    return marked.filter("is_train").drop("is_train"), marked.filter("not is_train").drop("is_train")


def fit_sample(rows: DataFrame, keys: list[str], fraction: float = SAMPLE_FRACTION) -> DataFrame:
    """``fraction`` of the rows, by an md5 bucket of the key apart from the split's.

    Only rows used to fit are sampled (the source job's data reduction); held-out rows are all scored.
    """
    return rows.filter(md5_bucket(keys, 1000, "fit") < int(1000 * fraction))


def sample_split(df: DataFrame, keys: list[str], fraction: float = SAMPLE_FRACTION) -> tuple[DataFrame, DataFrame]:
    """Sample without replacement, then split 80/20 (the source job's order of steps)."""
    return split_parts(fit_sample(df, keys, fraction), keys)


def index_labels(df: DataFrame, label: str, out: str = "label_index") -> DataFrame:
    """Labels as 0, 1, ... by falling frequency, ties by value (the source job's label index)."""
    from pyspark.ml.feature import StringIndexer

    text = df.withColumn("_label", F.col(label).cast("string"))
    return StringIndexer(inputCol="_label", outputCol=out, stringOrderType="frequencyDesc").fit(text).transform(text).drop("_label")


def laid_out(rows: DataFrame) -> DataFrame:
    """The rows dealt and ordered by their key, so that what a learner draws per task is alike on every layout of its input."""
    return rows.repartition(tasks_for(rows), *KEYS).sortWithinPartitions(*KEYS)


@contextmanager
def fitted_from(rows: DataFrame, cols: list[str] | None = None, out: str = "features") -> Iterator[DataFrame]:
    """``rows`` laid out and assembled, held on the executors' disks meanwhile: a learner reads its input several times, but it is dealt and ordered once."""
    held = assemble(laid_out(rows), cols, out).persist(StorageLevel.DISK_ONLY)
    try:
        yield held
    finally:
        held.unpersist()


def classifier_predictions(features_cls: DataFrame) -> DataFrame:
    """Random forest (gini, depth 4, 32 trees) on the 8 features; predictions on the 20 % held out.

    The label is the 0/1 ``bought_after`` cast to double (class 1 = bought).
    Output: user_id, shop_id, label, prediction, p_buy.
    """
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import vector_to_array

    data = stored(features_cls.withColumn("label", F.col("bought_after").cast("double")), "classify")
    train, test = split_parts(data, KEYS)
    rf = RandomForestClassifier(
        impurity="gini", maxDepth=FOREST_DEPTH, numTrees=FOREST_TREES, featureSubsetStrategy="auto", seed=FOREST_SEED
    )
    with fitted_from(train) as fit:
        pred = rf.fit(fit).transform(assemble(test))
    return pred.select(
        "user_id", "shop_id", "label", "prediction", vector_to_array("probability")[1].alias("p_buy")
    )


def roc_auc_evaluator(pred: DataFrame, score: str = "p_buy", label: str = "label") -> float:
    from pyspark.ml.evaluation import BinaryClassificationEvaluator

    ev = BinaryClassificationEvaluator(rawPredictionCol=score, labelCol=label, metricName="areaUnderROC", numBins=0)
    return ev.evaluate(pred.select(F.col(score).cast("double").alias(score), F.col(label).cast("double").alias(label)))


def rmse_evaluator(pred: DataFrame, prediction: str, label: str = "label") -> float:
    from pyspark.ml.evaluation import RegressionEvaluator

    ev = RegressionEvaluator(predictionCol=prediction, labelCol=label, metricName="rmse")
    return ev.evaluate(pred.select(F.col(prediction).cast("double").alias(prediction), F.col(label).cast("double").alias(label)))


def auc(pred: DataFrame, score: str, label: str) -> DataFrame:
    """Exact area under ROC with ties counted half: one row (auc, positives, negatives).

    Scores are grouped by a distributed aggregation. The number of negatives below
    a score is found in two steps: distinct scores are range-partitioned and
    written with their range, ranges are summed and added up (a row per range),
    and within a range a window adds up its scores. No task sees all scores.
    """
    is_pos = F.col(label) == 1
    g = pred.groupBy(F.col(score).cast("double").alias("s")).agg(
        F.sum(F.when(is_pos, 1).otherwise(0)).cast("long").alias("pos"),
        F.sum(F.when(is_pos, 0).otherwise(1)).cast("long").alias("neg"),
    )
    g = stored(g, "scores")
    g = stored(g.repartitionByRange(tasks_for(g), "s").withColumn("part", F.spark_partition_id()), "auc")
    rows_before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    parts = g.groupBy("part").agg(F.sum("neg").alias("part_neg"))
    parts = parts.select("part", F.coalesce(F.sum("part_neg").over(rows_before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    below = g.withColumn("in_part", F.coalesce(F.sum("neg").over(inside), F.lit(0))).join(parts, "part")
    wins = F.sum(F.col("pos") * (F.col("base") + F.col("in_part") + F.col("neg") * 0.5))
    pairs = F.sum("pos").cast("double") * F.sum("neg").cast("double")
    return below.agg(
        F.try_divide(wins, pairs).alias("auc"),
        F.sum("pos").cast("long").alias("positives"),
        F.sum("neg").cast("long").alias("negatives"),
    )


def rmse(pred: DataFrame, prediction: str, label: str) -> DataFrame:
    """Root mean squared error as one row (rmse, n)."""
    err = F.col(prediction).cast("double") - F.col(label).cast("double")
    return pred.agg(F.sqrt(F.avg(err * err)).alias("rmse"), F.count(F.lit(1)).alias("n"))


def residuals(pred: DataFrame, prediction: str, label: str, out: str = "residual") -> DataFrame:
    return pred.withColumn(out, F.col(prediction).cast("double") - F.col(label).cast("double"))


def join_predictions(a: DataFrame, b: DataFrame, keys: tuple[str, ...] = ("user_id", "shop_id")) -> DataFrame:
    """Predictions of two models side by side on the row key."""
    return a.join(b, list(keys))


def regression_predictions(features_reg: DataFrame, fit_fraction: float = SAMPLE_FRACTION) -> DataFrame:
    """Forest and GBT regressors of ``after_buy_count``; predictions on all of the 20 % held out.

    ``fit_fraction`` of the training rows are used to fit (the source job samples 20 %).
    Features go through a ``VectorIndexer`` (up to 8 categories). Output: the features,
    label, rf_prediction and gbt_prediction side by side.
    """
    from pyspark.ml.feature import VectorIndexer
    from pyspark.ml.regression import GBTRegressor, RandomForestRegressor

    data = stored(features_reg.withColumn("label", F.col("after_buy_count").cast("double")), "regress")
    train, test = split_parts(data, KEYS)
    with fitted_from(stored(fit_sample(train, KEYS, fit_fraction), "fit")) as fit:
        indexer = VectorIndexer(inputCol="features", outputCol="indexed", maxCategories=MAX_CATEGORIES, handleInvalid="keep").fit(fit)
        fit = indexer.transform(fit)
        rf = RandomForestRegressor(labelCol="label", featuresCol="indexed", featureSubsetStrategy="auto",
                                   seed=FOREST_SEED, predictionCol="rf_prediction").fit(fit)
        gbt = GBTRegressor(labelCol="label", featuresCol="indexed", maxIter=GBT_ITER, seed=FOREST_SEED,
                           predictionCol="gbt_prediction").fit(fit)
    pred = gbt.transform(rf.transform(indexer.transform(assemble(test))))
    return stored(pred.drop("features", "indexed"), "predictions")


def stack_logistic(pred: DataFrame) -> DataFrame:
    """Logistic regression over [rf, gbt] predictions, counts as classes; held-out rows with lr_prediction."""
    from pyspark.ml.classification import LogisticRegression

    train, test = split_parts(pred, KEYS, salt="stack")
    names = ["rf_prediction", "gbt_prediction"]
    lr = LogisticRegression(maxIter=LR_ITER, regParam=LR_REG, elasticNetParam=LR_ELASTIC_NET,
                            featuresCol="lr_features", labelCol="label", predictionCol="lr_prediction",
                            probabilityCol="lr_probability", rawPredictionCol="lr_raw")
    with fitted_from(train, names, "lr_features") as fit:
        return lr.fit(fit).transform(assemble(test, names, "lr_features"))


def stack_gbt(pred: DataFrame) -> DataFrame:
    """GBT over the 8 features plus both base predictions; held-out rows with gbt2_prediction."""
    from pyspark.ml.regression import GBTRegressor

    cols = FEATURE_COLUMNS + ["rf_prediction", "gbt_prediction"]
    train, test = split_parts(pred, KEYS, salt="stack")
    gbt = GBTRegressor(labelCol="label", featuresCol="gbt2_features", maxIter=GBT_ITER, seed=FOREST_SEED,
                       predictionCol="gbt2_prediction")
    with fitted_from(train, cols, "gbt2_features") as fit:
        return gbt.fit(fit).transform(assemble(test, cols, "gbt2_features"))
