"""Training, scoring, validation and explanation with Spark's own models."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import code as C
from . import metrics

# Sizes of the models by number of rows: up to, boosting rounds, trees, depth.
SIZES = [(100, 20, 30, 3), (500, 30, 50, 4), (1 << 62, 40, 60, 5)]


def _size(n: int) -> tuple[int, int, int]:
    return next((rounds, trees, depth) for most, rounds, trees, depth in SIZES if n <= most)


def _assembled(columns: list[str]) -> list:
    return [VectorAssembler(inputCols=columns, outputCol="_raw", handleInvalid="keep"), StandardScaler(inputCol="_raw", outputCol="_x", withMean=True, withStd=True)]


def train(table: DataFrame, columns: list[str], label: str, target: str, seed: int = 42) -> tuple[PipelineModel, PipelineModel]:
    """A boosted-trees classifier of ``label`` (0/1, the rarer class weighted up) and a random forest for
    ``target``.  Rows with a null label or target are left out of the respective model; null features are 0."""
    filled = table.fillna(0.0, columns)
    n = {r[label]: r["n"] for r in filled.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n")).collect()}
    rounds, trees, depth = _size(sum(n.values()))
    weight = n.get(0, 0) / n[1] if n.get(1) else 1.0
    weighted = filled.where(F.col(label).isNotNull()).withColumn("_w", F.when(F.col(label) == 1, max(weight, 1e-6)).otherwise(1.0)).withColumn("_y", F.col(label).cast("double"))
    classifier = Pipeline(stages=[*_assembled(columns), GBTClassifier(featuresCol="_x", labelCol="_y", weightCol="_w", maxIter=rounds, maxDepth=depth, stepSize=0.1, subsamplingRate=0.8, seed=seed)]).fit(weighted)
    regressor = Pipeline(stages=[*_assembled(columns), RandomForestRegressor(featuresCol="_x", labelCol="_t", numTrees=trees, maxDepth=depth + 2, seed=seed)]).fit(filled.where(F.col(target).isNotNull()).withColumn("_t", F.col(target).cast("double")))
    return classifier, regressor


_INNER = ["_raw", "_x", "rawPrediction", "probability", "prediction"]


def probability(table: DataFrame, classifier: PipelineModel, columns: list[str], name: str = "exploit_prob") -> DataFrame:
    return classifier.transform(table.fillna(0.0, columns)).withColumn(name, F.round(vector_to_array("probability")[1], 6)).drop(*_INNER)


def predicted(table: DataFrame, regressor: PipelineModel, columns: list[str], name: str = "risk_score") -> DataFrame:
    return regressor.transform(table.fillna(0.0, columns)).withColumn(name, F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("prediction"))), 6)).drop(*_INNER)


def scored(table: DataFrame, classifier: PipelineModel, regressor: PipelineModel, columns: list[str], severity: str) -> DataFrame:
    """With ``exploit_prob``, ``risk_score``, ``ml_severity`` and a ``note`` where the model's severity ranks above
    the rule's."""
    out = predicted(probability(table, classifier, columns), regressor, columns).withColumn("ml_severity", C.bucket(F.col("risk_score")))
    rank = lambda c: C.looked_up(C.SEVERITY_RANK, F.upper(c), 0)
    return out.withColumn("note", F.when(rank(F.col("ml_severity")) > rank(F.col(severity)), F.concat(F.lit("raised from "), F.col(severity))))


def importances(classifier: PipelineModel, regressor: PipelineModel, columns: list[str]) -> dict[str, tuple[float, float]]:
    a, b = classifier.stages[-1].featureImportances.toArray(), regressor.stages[-1].featureImportances.toArray()
    return {c: (float(x), float(y)) for c, x, y in zip(columns, a, b, strict=True)}


def explained(table: DataFrame, weights: dict[str, tuple[float, float]], k: int = 5) -> DataFrame:
    """With ``top``: the ``k`` features of the largest contribution, mean over both models of the importance's
    share times the value; ties in the order of the features."""
    sums = [sum(w[i] for w in weights.values()) or 1.0 for i in (0, 1)]
    parts = [F.struct((-F.abs(F.col(c) * ((w[0] / sums[0] + w[1] / sums[1]) / 2))).alias("_o"), F.lit(i).alias("_i"), F.lit(c).alias("feature"), F.round(F.col(c) * ((w[0] / sums[0] + w[1] / sums[1]) / 2), 6).alias("contribution")) for i, (c, w) in enumerate(weights.items())]
    return table.withColumn("top", F.transform(F.slice(F.array_sort(F.array(*parts)), F.lit(1), F.lit(k)), lambda x: F.struct(x["feature"], x["contribution"])))


def partial_dependence(table: DataFrame, model: PipelineModel, columns: list[str], feature: str, points: int = 50) -> DataFrame:
    """``value, mean``: the mean prediction with the feature set to each of evenly spaced values; each row is
    scored once a point, within its task."""
    least, most = table.agg(F.min(feature), F.max(feature)).first()
    if least is None:
        return table.sparkSession.createDataFrame([], "value double, mean double")
    step = (most - least) / (points - 1)
    grid = F.explode(F.array(*[F.lit(float(least + step * i)) for i in range(points)]))
    rows = table.select(*[c for c in columns if c != feature]).withColumn(feature, grid)
    out = model.transform(rows.fillna(0.0, columns))
    value = vector_to_array("probability")[1] if "probability" in out.columns else F.col("prediction")
    return out.groupBy(F.col(feature).alias("value")).agg(F.avg(value).alias("mean"))


def cross_validated(table: DataFrame, columns: list[str], label: str, target: str, id_: str, k: int = 5) -> DataFrame:
    """``measure, mean, deviation`` over folds made by hash, of both models."""
    folded = metrics.folds(table, id_, k)
    rows = None
    for f in range(k):
        a, b = train(folded.where(F.col("fold") != f), columns, label, target)
        held = predicted(probability(folded.where(F.col("fold") == f), a, columns), b, columns)
        c = metrics.confusion(held.withColumn("_g", (F.col("exploit_prob") >= 0.5).cast("int")), label, "_g").select(F.lit(f).alias("fold"), "accuracy", "precision", "recall", "f1")
        r = metrics.regression(held, target, "risk_score").select(F.lit(f).alias("fold"), "mae", "rmse", "r2")
        one = c.join(r, "fold")
        rows = one if rows is None else rows.unionByName(one)
    return metrics.over_folds(rows, ["accuracy", "precision", "recall", "f1", "mae", "rmse", "r2"])


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def text_model(score: object) -> object:
    """A place for a model of code texts: a vectorised function from a series of texts to probabilities, as a
    column function.  Without a model its part of the ensemble is null and its weight falls to the others."""

    def apply(column: Column) -> Column:
        if score is None:
            return F.lit(None).cast("double")
        return F.pandas_udf(score, "double")(column)

    return apply
