"""Training a classifier from table to report."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tractloom.operators import learning as ml


def train(df: DataFrame, kind: str = "logistic_l2", c: float = 1.0, test: float = 0.2, validation: float = 0.2, seed: int = 42) -> tuple[PipelineModel, DataFrame]:
    """A model fitted on the training share with balanced weights, and what it is worth: (part, n, auc, accuracy, precision, recall, f1). df (id, label 0/1, features)."""
    x = ml.with_vector(ml.stratified_split(df.select("id", F.col("label").cast("double").alias("label"), "features"), test, validation, seed=seed)).cache()
    rows = ml.balanced(x.where("split = 'train'"))
    model = ml.classifier(kind, c, rows.count(), seed=seed, weight="weight").fit(rows)
    got = []
    for part in ("train", "validation", "test"):
        out = model.transform(x.where(F.col("split") == part))
        got.append((part, out.count(), float(BinaryClassificationEvaluator(labelCol="label").evaluate(out)), *map(float, ml.scores(out).first())))
    x.unpersist()
    return model, df.sparkSession.createDataFrame(got, "part string, n long, auc double, accuracy double, precision double, recall double, f1 double")


def save(model: PipelineModel, report: DataFrame, path: str) -> None:
    """The model and its report in a folder."""
    model.write().overwrite().save(f"{path}/model")
    report.write.mode("overwrite").json(f"{path}/report")


def load(path: str) -> PipelineModel:
    return PipelineModel.load(f"{path}/model")
