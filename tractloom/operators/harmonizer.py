"""Site harmonisation as an Estimator: fitted on some rows, saved, and applied to others."""

from __future__ import annotations

from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tractloom.operators import harmonize as hz
from tractloom.session import checkpoint_folder


class _Choices(Params):
    meanOnly = Param(Params._dummy(), "meanOnly", "remove the batches' locations only, not their scales", TypeConverters.toBoolean)
    shrink = Param(Params._dummy(), "shrink", "shrink locations and scales towards the batch's other features", TypeConverters.toBoolean)
    location = Param(Params._dummy(), "location", "own: new rows are centred by their own batch means; fitted: by those of the fit, row by row", TypeConverters.toString)

    def __init__(self) -> None:
        super().__init__()
        self._setDefault(meanOnly=False, shrink=True, location="own")

    def _chosen(self, values: dict) -> None:
        if values.get("location", "own") not in ("own", "fitted"):
            raise ValueError("location is own or fitted")
        self._set(**values)


class Harmonizer(Estimator, _Choices, DefaultParamsReadable, DefaultParamsWritable):
    """Fits batches on long rows (id, batch, feature, value). A null batch is a batch; null values count nothing; other columns are not used.

    Covariates are taken out before, by harmonize.residuals.
    """

    def __init__(self, **choices) -> None:
        super().__init__()
        self._chosen(choices)

    def _fit(self, dataset: DataFrame) -> HarmonizerModel:
        v = dataset.select("id", "batch", "feature", "value")
        p = hz.batch_parameters(hz.standardized(v).where(F.col("z").isNotNull()))
        b = v.groupBy(F.col("feature").alias("_f"), F.col("batch").alias("_b")).agg(F.sum("value").alias("_s"), F.count("value").alias("_n"))
        every = Window.partitionBy("_f")
        m = b.select("_f", "_b", F.try_divide("_s", "_n").alias("batch_mean"), F.try_divide(F.sum("_s").over(every), F.sum("_n").over(every)).alias("stand_mean"))
        same = F.col("feature").eqNullSafe(F.col("_f")) & F.col("batch").eqNullSafe(F.col("_b"))
        table = p.join(m, same).select("feature", "batch", "n", "batch_mean", "stand_mean", "gamma", "delta", "gamma_star", "delta_star")
        checkpoint_folder(dataset.sparkSession)
        return self._copyValues(HarmonizerModel(table.checkpoint()))


class HarmonizerModel(Model, _Choices, MLReadable, MLWritable):
    """What a fit found: parameters has a row per feature and batch.

    transform() keeps id, batch, feature and value. Rows of a batch or feature that the fit didn't see stop the job: they have no
    defined result. A batch's spread that can't be estimated (one row) leaves the scale as it is.
    """

    def __init__(self, parameters: DataFrame | None = None) -> None:
        super().__init__()
        self.parameters = parameters

    def _transform(self, dataset: DataFrame) -> DataFrame:
        g, s = ("gamma_star", "delta_star") if self.getOrDefault("shrink") else ("gamma", "delta")
        p = self.parameters.select(
            F.col("feature").alias("_f"), F.col("batch").alias("_b"), "batch_mean", "stand_mean", F.col(g).alias("_g"),
            F.coalesce(F.try_divide(F.col(s), F.avg(s).over(Window.partitionBy("feature"))), F.lit(1.0)).alias("_k"), F.lit(True).alias("_known"),
        )
        v = dataset.select("id", "batch", "feature", "value")
        same = F.col("feature").eqNullSafe(F.col("_f")) & F.col("batch").eqNullSafe(F.col("_b"))
        if self.getOrDefault("location") == "own":
            own = v.groupBy(F.col("feature").alias("_of"), F.col("batch").alias("_ob")).agg(F.avg("value").alias("own_mean"))
            p = own.join(p, F.col("_of").eqNullSafe(F.col("_f")) & F.col("_ob").eqNullSafe(F.col("_b")), "left").drop("_f", "_b", "batch_mean")
            p = p.withColumnsRenamed({"_of": "_f", "_ob": "_b", "own_mean": "batch_mean"})
        x = v.join(p, same, "left")
        z = F.col("value") - F.col("batch_mean") + F.col("stand_mean") - F.col("_g")
        if not self.getOrDefault("meanOnly"):
            z = z / F.greatest(F.sqrt(F.col("_k")), F.lit(1e-8))
        strange = F.raise_error(F.concat(F.lit("not in the fit: batch "), F.coalesce(F.col("batch").cast("string"), F.lit("null")), F.lit(", feature "), F.coalesce(F.col("feature").cast("string"), F.lit("null"))))
        return x.select("id", "batch", "feature", F.when(F.col("_known"), z + F.col("stand_mean")).otherwise(strange.cast("double")).alias("value"))

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader()


class _Writer(MLWriter):
    def __init__(self, model: HarmonizerModel) -> None:
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession)
        self.model.parameters.write.parquet(f"{path}/parameters")


class _Reader(MLReader):
    def load(self, path: str) -> HarmonizerModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = HarmonizerModel(self.sparkSession.read.parquet(f"{path}/parameters"))
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model
