"""Classification of feature vectors and its evaluation. Training and prediction are pyspark.ml; curves and tables are SQL."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tractloom.functions import rng
from tractloom.functions import scalars as s
from tractloom.functions.ordered import bounds, bucket, running

# scored: (id, y 0/1, score)


def _by_score(scored: DataFrame) -> DataFrame:
    """One row per distinct score with running counts from the top. Rows are counted before they are ordered."""
    g = scored.groupBy("score").agg(F.sum("y").alias("p"), F.count(F.lit(1)).alias("n"))
    return running(g, "score", {"tp": F.col("p"), "fp": F.col("n") - F.col("p")}, descending=True)


def _totals(scored: DataFrame) -> DataFrame:
    return F.broadcast(scored.agg(F.sum("y").alias("pos"), (F.count(F.lit(1)) - F.sum("y")).alias("neg")))


def roc_curve(scored: DataFrame) -> DataFrame:
    return _by_score(scored).crossJoin(_totals(scored)).select("score", F.coalesce(F.try_divide(F.col("fp").cast("double"), F.col("neg")), F.lit(0.0)).alias("fpr"), F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("pos")), F.lit(0.0)).alias("tpr"))


def auc(scored: DataFrame) -> DataFrame:
    """Trapezoids between distinct scores."""
    c = _by_score(scored)
    area = (F.col("n") - F.col("p")) * (2 * F.col("tp") - F.col("p")) / 2.0
    return c.select(area.alias("a")).agg(F.sum("a").alias("a")).crossJoin(_totals(scored)).select(F.try_divide(F.col("a"), F.col("pos") * F.col("neg")).alias("auc"))


def pr_curve(scored: DataFrame) -> DataFrame:
    return _by_score(scored).crossJoin(_totals(scored)).select("score", (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"), F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("pos")), F.lit(0.0)).alias("recall"))


def average_precision(scored: DataFrame) -> DataFrame:
    c = _by_score(scored).crossJoin(_totals(scored))
    return c.agg(F.sum(F.try_divide(F.col("p").cast("double"), F.col("pos")) * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("average_precision"))


def calibration(scored: DataFrame, bins: int = 10) -> DataFrame:
    b = F.least(F.floor(F.col("score") * bins), F.lit(bins - 1)).cast("int")
    return scored.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean_score"), F.avg(F.col("y").cast("double")).alias("share"))


def brier(scored: DataFrame) -> DataFrame:
    return scored.agg(F.avg(F.pow(F.col("score") - F.col("y"), 2)).alias("brier"))


def confusion(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("y", "predicted").agg(F.count(F.lit(1)).alias("n"))


def class_report(pairs: DataFrame) -> DataFrame:
    """Precision, recall, f1 and support per class of (y, predicted)."""
    c = confusion(pairs)
    rows = c.select(F.col("y").alias("class"), F.when(F.col("y") == F.col("predicted"), F.col("n")).otherwise(0).alias("hit"), F.col("n").alias("is"), F.lit(0).alias("said")).union(c.select("predicted", F.lit(0), F.lit(0), "n"))
    r = rows.groupBy("class").agg(F.sum("hit").alias("hit"), F.sum("is").alias("support"), F.sum("said").alias("said"))
    z = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0))
    r = r.withColumn("precision", z("hit", "said")).withColumn("recall", z("hit", "support"))
    return r.select("class", "precision", "recall", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)).alias("f1"), "support")


def places(df: DataFrame, label: str = "label", seed: int = 42) -> DataFrame:
    """df with _place, a row's place in its label in a random order from 1 on, and _size, the label's rows.

    The order's hash cuts a label into 4096 even parts. Rows are sorted inside a part, and windows over a whole label see one row per part.
    """
    x = df.withColumn("_key", rng.order_key(seed, "id")).withColumn("_part", F.substring("_key", 1, 3))
    n = x.groupBy(label, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(label).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    skip = n.select(F.col(label).alias("_label"), F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_skip"), F.sum("_n").over(Window.partitionBy(label)).alias("_size"))
    inside = x.withColumn("_in", F.row_number().over(Window.partitionBy(label, "_part").orderBy("_key", "id")))
    got = inside.join(skip, F.col(label).eqNullSafe(F.col("_label")) & (F.col("_part") == F.col("_p")))
    return got.select(*df.columns, (F.col("_skip") + F.col("_in")).alias("_place"), "_size")


def stratified_folds(df: DataFrame, k: int, label: str = "label", seed: int = 42) -> DataFrame:
    return places(df, label, seed).withColumn("fold", ((F.col("_place") - 1) % k).cast("int")).drop("_place", "_size")


def stratified_split(df: DataFrame, test: float = 0.2, validation: float = 0.2, label: str = "label", seed: int = 42) -> DataFrame:
    """train, validation or test per row: first the test share of each label, then the validation share of the rest."""
    n, k = F.col("_size"), F.col("_place")
    n_test = F.round(n * test)
    n_val = F.round((n - n_test) * validation)
    return places(df, label, seed).withColumn("split", F.when(k <= n_test, "test").when(k <= n_test + n_val, "validation").otherwise("train")).drop("_place", "_size")


def scaled(values: DataFrame) -> DataFrame:
    """z-scores with the population's spread. values (id, feature, value)."""
    m = values.groupBy(F.col("feature").alias("_f")).agg(F.avg("value").alias("_m"), F.stddev_pop("value").alias("_sd"))
    sd = F.when(F.col("_sd") > 0, F.col("_sd")).otherwise(1.0)
    return values.join(m, F.col("feature").eqNullSafe(F.col("_f"))).select("id", "feature", ((F.col("value") - F.col("_m")) / sd).alias("value"))


def with_vector(df: DataFrame, features: str = "features") -> DataFrame:
    return df.withColumn("v", array_to_vector(F.col(features).cast("array<double>")))


def balanced(df: DataFrame, label: str = "label") -> DataFrame:
    """Weights n / (classes * n of the class)."""
    c = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    t = c.agg(F.sum("_n").alias("_t"), F.count(F.lit(1)).alias("_k"))
    w = c.crossJoin(F.broadcast(t)).select(label, (F.col("_t") / (F.col("_k") * F.col("_n"))).alias("weight"))
    return df.join(w, label)


def classifier(kind: str = "logistic_l2", c: float = 1.0, n: int = 1, trees: int = 100, depth: int = 5, least: int = 1, seed: int = 42, weight: str | None = None) -> Pipeline:
    """Scaling and a classifier: logistic_l1, logistic_l2, elasticnet (c: inverse strength over n rows) or random_forest."""
    scale = StandardScaler(inputCol="v", outputCol="z", withMean=True, withStd=True)
    extra = {"weightCol": weight} if weight else {}
    if kind == "random_forest":
        model = RandomForestClassifier(featuresCol="z", labelCol="label", numTrees=trees, maxDepth=depth, minInstancesPerNode=least, seed=seed, **extra)
    else:
        mix = {"logistic_l1": 1.0, "logistic_l2": 0.0, "elasticnet": 0.5}[kind]
        model = LogisticRegression(featuresCol="z", labelCol="label", regParam=1.0 / (c * max(n, 1)), elasticNetParam=mix, maxIter=200, **extra)
    return Pipeline(stages=[scale, model])


def predict(model: PipelineModel, df: DataFrame) -> DataFrame:
    """id, predicted, confidence, uncertainty and a probability per class."""
    p = model.transform(df).withColumn("p", vector_to_array("probability"))
    return p.select("id", F.col("prediction").cast("int").alias("predicted"), s.confidence(F.col("p")).alias("confidence"), s.entropy(F.col("p")).alias("uncertainty"), F.col("p").alias("probabilities"))


def scores(predicted: DataFrame) -> DataFrame:
    """accuracy, precision, recall and f1 of predictions (label, prediction); 0 where there is nothing to divide by."""
    hit = lambda p, y: F.count_if((F.col("prediction") == p) & (F.col("label") == y)).cast("double")
    c = predicted.agg(hit(1, 1).alias("tp"), hit(1, 0).alias("fp"), hit(0, 1).alias("fn"), hit(0, 0).alias("tn"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    tp, fp, fn, tn = (F.col(k) for k in ("tp", "fp", "fn", "tn"))
    return c.select(ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"), ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))


def cross_validate(df: DataFrame, k: int = 5, kind: str = "logistic_l2", c: float = 1.0, seed: int = 42) -> DataFrame:
    """fold, auc, accuracy, precision, recall and f1 of the rows left out, and the same of the training rows (train_). Scaling is fitted inside each fold. df (id, label 0/1, features)."""
    x = with_vector(stratified_folds(df, k, seed=seed)).cache()
    rows = []
    names = ("accuracy", "precision", "recall", "f1")
    for f in range(k):
        train, test = x.where(F.col("fold") != f), x.where(F.col("fold") == f)
        model = classifier(kind, c, train.count(), seed=seed).fit(train)
        row = [f]
        for part in (test, train):
            out = model.transform(part)
            row += [float(BinaryClassificationEvaluator(labelCol="label").evaluate(out)), *map(float, scores(out).first())]
        rows.append(tuple(row))
    x.unpersist()
    return df.sparkSession.createDataFrame(rows, "fold int, " + ", ".join(f"{p}{n} double" for p in ("", "train_") for n in ("auc", *names)))


def auc_permutation(df: DataFrame, n_perm: int = 100, k: int = 5, kind: str = "logistic_l2", c: float = 1.0, seed: int = 42) -> DataFrame:
    """observed mean AUC over folds and its p: the share, of all labellings and the real one, that do as well. Labels are dealt anew by a hash order of the ids."""
    spark = df.sparkSession
    rows = df.select("id", "label", "features").cache()
    mean = lambda x: cross_validate(x, k, kind, c, seed).agg(F.avg("auc")).first()[0]
    observed, hits = mean(rows), 0
    for p in range(1, n_perm + 1):
        place = running(rows.withColumn("_u", rng.uniform(seed, F.lit(p), "id")), "_u", {"_place": F.lit(1)}, ties=("id",))
        label = running(rows.select("id", "label"), "id", {"_place": F.lit(1)}).select("_place", "label")
        hits += mean(place.drop("label", "_u").join(label, "_place").drop("_place")) >= observed
    rows.unpersist()
    return spark.createDataFrame([(float(observed), (hits + 1) / (n_perm + 1), n_perm)], "observed double, p double, n_perm int")


def partners(df: DataFrame, seed: int = 42) -> DataFrame:
    """df (id, label, features) with _other, the features of the row that each is dealt: a permutation of the rows."""
    x = df.select("id", "label", "features")
    placed = lambda k: running(x.withColumn("_u", rng.uniform(seed, F.lit(k), "id")), "_u", {"_place": F.lit(1)}, ties=("id",)).drop("_u")
    return placed("to").join(placed("from").select("_place", F.col("features").alias("_other")), "_place").drop("_place")


def permutation_importance(model: PipelineModel, df: DataFrame, seed: int = 42) -> DataFrame:
    """(feature, importance): how much the AUC falls when a feature's values come from other rows. df (id, label, features).

    One permutation of rows serves every feature, so only whole rows are shuffled; the rows of each feature are made where
    they are scored, and leave as counts of scores. These are ordered in buckets of the unchanged rows' scores.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # rows grow by the number of features after this: few tasks would hold them
    each = partners(df, seed).repartition(parts, "id").withColumn("feature", F.explode(F.sequence(F.lit(-1), F.size("features") - 1)))  # -1 changes nothing
    swapped = each.select("feature", "label", F.transform("features", lambda v, k: F.when(k == F.col("feature"), F.col("_other")[k]).otherwise(v)).alias("features"))
    score = vector_to_array("probability")[1].alias("score")
    cuts = bounds(model.transform(with_vector(df.select("features"))).select(score), "score")
    p = model.transform(with_vector(swapped)).select("feature", "label", score)
    # AUC by counts of each score: pairs of a positive and a negative row in the right order, ties half.
    n = p.groupBy("feature", "score").agg(F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg")).withColumn("_b", bucket("score", cuts))
    first = Window.unboundedPreceding
    lower = Window.partitionBy("_f").orderBy("_c").rowsBetween(first, -1)
    skip = n.groupBy(F.col("feature").alias("_f"), F.col("_b").alias("_c")).agg(F.sum("neg").alias("k")).select("_f", "_c", F.coalesce(F.sum("k").over(lower), F.lit(0)).alias("skip"))
    inner = Window.partitionBy("feature", "_b").orderBy("score").rowsBetween(first, -1)
    pairs = n.withColumn("less", F.coalesce(F.sum("neg").over(inner), F.lit(0))).join(skip, (F.col("feature") == F.col("_f")) & (F.col("_b") == F.col("_c")))
    less = F.col("skip") + F.col("less")
    auc = pairs.groupBy("feature").agg(F.try_divide(F.sum(F.col("pos") * (less + F.col("neg") / 2)), F.sum("pos") * F.sum("neg")).alias("auc"))
    base = auc.where("feature < 0").select(F.col("auc").alias("base"))
    return auc.where("feature >= 0").crossJoin(F.broadcast(base)).select("feature", (F.col("base") - F.col("auc")).alias("importance"))


def grid_search(df: DataFrame, grid: tuple[float, ...] = (0.01, 0.1, 1.0, 10.0), k: int = 3, seed: int = 42) -> tuple[PipelineModel, DataFrame]:
    """The model of the best mean AUC over folds, and the scores of the grid."""
    x = with_vector(stratified_folds(df, k, seed=seed)).withColumn("label", F.col("label").cast("double"))
    n = x.count()
    pipe = classifier()
    lr = pipe.getStages()[-1]
    params = ParamGridBuilder().addGrid(lr.regParam, [1.0 / (c * n) for c in grid]).build()
    cv = CrossValidator(estimator=pipe, estimatorParamMaps=params, evaluator=BinaryClassificationEvaluator(labelCol="label"), numFolds=k, foldCol="fold", parallelism=2).fit(x)
    return cv.bestModel, df.sparkSession.createDataFrame([(float(c), float(a)) for c, a in zip(grid, cv.avgMetrics, strict=True)], "c double, auc double")


def linear_contributions(model: PipelineModel, df: DataFrame) -> DataFrame:
    """(id, feature, phi): coefficient times the feature's distance from the mean, on the scaled axis. For logistic models."""
    coef = [float(v) for v in model.stages[-1].coefficients.toArray()]
    z = model.stages[0].transform(df).select("id", F.posexplode(vector_to_array("z")).alias("feature", "z"))
    w = F.array(*[F.lit(v) for v in coef])
    return z.select("id", "feature", (F.col("z") * F.element_at(w, F.col("feature") + 1)).alias("phi"))


def top_contributions(phi: DataFrame, n: int = 10) -> DataFrame:
    w = Window.partitionBy("id").orderBy(F.desc(F.abs("phi")), "feature")
    return phi.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def importance(model: PipelineModel) -> list[tuple[int, float]]:
    last = model.stages[-1]
    v = last.featureImportances.toArray() if hasattr(last, "featureImportances") else abs(last.coefficients.toArray())
    return sorted(enumerate(map(float, v)), key=lambda p: (-p[1], p[0]))


def prediction_report(predictions: DataFrame) -> DataFrame:
    """Rows per class with the spread of confidence."""
    c = "confidence"
    return predictions.groupBy("predicted").agg(F.count(F.lit(1)).alias("n"), F.avg(c).alias("mean"), F.stddev_pop(c).alias("std"), F.min(c).alias("min"), F.max(c).alias("max"), F.percentile(c, 0.5).alias("median"))
