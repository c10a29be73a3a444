"""Linear one-vs-rest classification of feature vectors."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LinearSVC, OneVsRest
from pyspark.ml.feature import ElementwiseProduct, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.operators.linear_models import measures_of, predict_together, stratified_folds, train_together
from kindred.operators.scale_out import materialise


def standardise(rows: DataFrame, feature: str) -> DataFrame:
    """Zero mean and unit population deviation per dimension; a constant dimension becomes 0.

    The statistics come from one pass over the vectors, as one short row attached by a scalar
    subquery.
    """
    summary = Summarizer.metrics("mean", "variance", "count").summary(array_to_vector(feature))
    n = F.col("s.count")
    stats = rows.agg(summary.alias("s")).select(
        F.struct(
            vector_to_array("s.mean").alias("mean"),
            # the summary holds the sample variance
            F.transform(vector_to_array("s.variance"), lambda v: F.sqrt(v * (n - 1) / n)).alias("std"),
        ).alias("stats")
    ).scalar()
    centred = F.zip_with(feature, "_stats.mean", lambda x, m: x - m)
    unit = F.zip_with(centred, "_stats.std", lambda x, s: F.coalesce(F.try_divide(x, s), F.lit(0.0)))
    return rows.withColumn("_stats", stats).withColumn(feature, unit).drop("_stats")


def _prepared(rows: DataFrame, feature: str, label: str) -> DataFrame:
    return rows.select("*", array_to_vector(feature).alias("features"), F.col(label).cast("double").alias("label_code"))


def train(rows: DataFrame, feature: str, label: str, iterations: int = 50, parallelism: int = 8) -> PipelineModel:
    """Scaler and one linear SVM per class, each trained on the whole table."""
    svm = LinearSVC(maxIter=iterations, regParam=0.01)
    size = rows.agg(F.count("*").alias("n"), F.max(F.size(feature)).alias("dim")).first()
    # The scaler divides by the sample deviation; this factor makes it the population one.
    factor = (size["n"] / max(1, size["n"] - 1)) ** 0.5
    stages = [
        StandardScaler(inputCol="features", outputCol="sample_scaled", withMean=True),
        ElementwiseProduct(inputCol="sample_scaled", outputCol="scaled_features", scalingVec=Vectors.dense([factor] * (size["dim"] or 0))),
        OneVsRest(classifier=svm, featuresCol="scaled_features", labelCol="label_code", parallelism=parallelism),
    ]
    return Pipeline(stages=stages).fit(_prepared(rows, feature, label))


def predict(model: PipelineModel, rows: DataFrame, feature: str, label: str) -> DataFrame:
    """Rows with ``predicted``; the dimension of the vectors must be the trained one."""
    check_dimension(model, rows, feature)
    kept = rows.columns
    scored = model.transform(_prepared(rows, feature, label))
    return scored.select(*kept, F.col("prediction").cast("int").alias("predicted"))


def check_dimension(model: PipelineModel, rows: DataFrame, feature: str) -> None:
    trained = len(model.stages[0].mean)
    other = rows.select(F.size(feature).alias("n")).filter(F.coalesce(F.col("n") != trained, F.lit(True))).first()
    if other is not None:
        raise ValueError(f"the model was trained on {trained} dimensions, the data has {other['n']}")


def accuracy(predicted: DataFrame, label: str) -> DataFrame:
    return predicted.agg(F.avg((F.col("predicted") == F.col(label)).cast("double")).alias("accuracy"))


def cross_validate(
    rows: DataFrame, feature: str, label: str, folds: int = 10, iterations: int = 50, measure: str = "accuracy",
    fold_of: Column | None = None,
) -> DataFrame:
    """``measure`` per fold (accuracy, f1, weightedPrecision or weightedRecall).

    Folds are dealt within each class, see ``stratified_folds``, or come from ``fold_of``. The models of all classes and folds are trained together.
    """
    cut = stratified_folds(rows, label, folds, name="_fold") if fold_of is None else rows.withColumn("_fold", fold_of)
    cut = materialise(cut.select("id", feature, label, "_fold"), "folds")
    models = train_together(cut, feature, label, "_fold", folds, iterations)
    judged = predict_together(models, cut, feature, "_fold").filter(F.col("predicted").isNotNull() & F.col(label).isNotNull())
    counts: dict[int, dict] = {f: {} for f in range(folds)}
    # At most a row for every fold and pair of classes.
    for r in judged.groupBy("_fold", F.col(label).alias("true"), "predicted").count().collect():
        counts[r["_fold"]][r["true"], r["predicted"]] = r["count"]
    scores = [(f, measures_of(c)[measure]) for f, c in counts.items() if c]
    return rows.sparkSession.createDataFrame(scores, f"fold int, `{measure}` double")


def cross_validate_labels(
    rows: DataFrame, feature: str, labels: list[str], folds: int = 10, iterations: int = 50, measure: str = "accuracy"
) -> DataFrame:
    """Mean of ``measure`` over the folds for every column of a multi-label table."""
    parts = [
        cross_validate(rows, feature, name, folds, iterations, measure).agg(
            F.lit(name).alias("label"), F.avg(measure).alias(measure)
        )
        for name in labels
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
