"""Models on pyspark.ml: imputation with indicators, weighted logistic regression, boosting, isotonic calibration,
linear explanations, folds by key, bootstrap, and clustering with lineage."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_indicators(rows: DataFrame, features: list[str]) -> tuple[DataFrame, list[str]]:
    """Adds <feature>_missing columns; features become double."""
    made = {f"{f}_missing": F.col(f).isNull().cast("double") for f in features}
    return rows.withColumns({f: F.col(f).cast("double") for f in features}).withColumns(made), [*features, *made]


def balanced(rows: DataFrame, label: str) -> DataFrame:
    """Adds weight: each class has half of the total."""
    n = rows.groupBy(F.col(label).alias("__y")).agg(F.count(F.lit(1)).alias("__k"))
    total = rows.agg(F.count(F.lit(1)).alias("__n"))
    return rows.join(F.broadcast(n), F.col(label) == F.col("__y")).join(F.broadcast(total)).withColumn("weight", F.col("__n") / (2 * F.col("__k"))).drop("__y", "__k", "__n")


def _prepared(features: list[str], every: list[str]) -> list:
    return [Imputer(strategy="median", inputCols=features, outputCols=[f"{f}__i" for f in features]), VectorAssembler(inputCols=[*[f"{f}__i" for f in features], *[x for x in every if x not in features]], outputCol="raw"), StandardScaler(inputCol="raw", outputCol="features", withMean=True)]


def fit_logistic(rows: DataFrame, features: list[str], label: str, strength: float = 2.0) -> PipelineModel:
    """Median imputation, indicators, standardising, and a class-balanced logistic regression."""
    rows, every = with_indicators(rows, features)
    n = rows.count()
    return Pipeline(stages=[*_prepared(features, every), LogisticRegression(labelCol=label, weightCol="weight", regParam=strength / max(1, n))]).fit(balanced(rows, label))


def fit_boosted(rows: DataFrame, features: list[str], label: str, depth: int = 3, rounds: int = 20, rate: float = 0.1, seed: int = 0) -> PipelineModel:
    rows, every = with_indicators(rows, features)
    return Pipeline(stages=[*_prepared(features, every), GBTClassifier(labelCol=label, maxDepth=depth, maxIter=rounds, stepSize=rate, seed=seed)]).fit(rows)


def probabilities(model: PipelineModel, rows: DataFrame, features: list[str], name: str = "p") -> DataFrame:
    """rows with the probability of the positive class."""
    made, _ = with_indicators(rows, features)
    return model.transform(made).withColumn(name, vector_to_array("probability")[1]).select(*rows.columns, name)


def explained(model: PipelineModel, rows: DataFrame, features: list[str], top: int = 4) -> DataFrame:
    """Adds explanation: the contributions (coefficient times standardised value) largest in size."""
    made, every = with_indicators(rows, features)
    weights = model.stages[-1].coefficients.toArray().tolist()
    z = vector_to_array("features")
    parts = F.array(*[F.struct((-F.abs(z[i] * w)).alias("size"), F.lit(n).alias("name"), (z[i] * w).alias("value")) for i, (n, w) in enumerate(zip(every, weights))])
    return model.transform(made).withColumn("explanation", F.transform(F.slice(F.array_sort(parts), 1, top), lambda x: F.struct(x["name"].alias("name"), x["value"].alias("value")))).select(*rows.columns, "explanation")


def folds(key: Column, k: int) -> Column:
    """A fold by key alone: a group's rows stay together whatever the partitioning."""
    return F.pmod(F.xxhash64(key), F.lit(k)).cast("int")


def out_of_fold(rows: DataFrame, features: list[str], label: str, group: str, k: int = 5, fit=fit_logistic) -> DataFrame:
    """rows with p predicted by models that haven't seen the row's group; k models, a driver loop over folds only."""
    rows = rows.withColumn("__fold", folds(F.col(group), k))
    out = None
    for i in range(k):
        part = rows.where(F.col("__fold") == i)
        scored = probabilities(fit(rows.where(F.col("__fold") != i), features, label), part, features)
        out = scored if out is None else out.unionByName(scored)
    return out.drop("__fold")


def calibration_table(rows: DataFrame, score: str, label: str, points: int = 21) -> list[tuple[float, float]]:
    """Isotonic regression read at evenly spaced scores from 0 to 1."""
    model = IsotonicRegression(labelCol=label, featuresCol="__f").fit(rows.select(array_to_vector(F.array(F.col(score).cast("double"))).alias("__f"), F.col(label).cast("double").alias(label)))
    grid = rows.sparkSession.range(points).select(F.col("id"), (F.col("id") / (points - 1)).alias("x")).withColumn("__f", array_to_vector(F.array("x")))
    return [(r["x"], r["prediction"]) for r in model.transform(grid).orderBy("id").collect()]


def bootstrap(rows: DataFrame, value: str, label: str, times: int = 200, seed: int = 7) -> DataFrame:
    """(low, high): the middle 95 % of label means, by Poisson weights for each row and repetition."""
    y = F.col(label).cast("double")

    def drawn(i: int) -> Column:
        u = F.pmod(F.xxhash64(F.lit(i), F.lit(seed), *[F.col(c) for c in rows.columns]), F.lit(1 << 30)) / (1 << 30)
        return F.when(u < 0.36788, 0).when(u < 0.73576, 1).when(u < 0.91970, 2).when(u < 0.98101, 3).when(u < 0.99634, 4).otherwise(5)

    # All repetitions in one aggregation of two sums each: no row is written out more than once.
    sums = rows.agg(*[x for i in range(times) for x in (F.sum(drawn(i) * y).alias(f"a{i}"), F.sum(drawn(i)).alias(f"b{i}"))])
    means = sums.select(F.explode(F.array(*[F.try_divide(F.col(f"a{i}"), F.col(f"b{i}")) for i in range(times)])).alias("m"))
    return means.agg(F.percentile("m", F.array(F.lit(0.025), F.lit(0.975))).alias("q")).select(F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))


def clusters(rows: DataFrame, k: int, vec_col: str = "embedding", seed: int = 3) -> DataFrame:
    """rows with cluster, by seeded k-means."""
    made = rows.withColumn("__v", array_to_vector(F.transform(vec_col, lambda x: x.cast("double"))))
    return KMeans(k=k, seed=seed, featuresCol="__v", predictionCol="cluster").fit(made).transform(made).drop("__v")


def lineage(early: DataFrame, late: DataFrame, sibling: float = 0.0) -> DataFrame:
    """(cluster, parent, similarity, born) from centroids (cluster, centroid) of two windows: a cluster is born where no
    earlier one is more similar than its nearest sibling."""
    from glimmer.operators.vectors import cosine

    # Both sides are one row per cluster, a parameter of the clustering.
    near = late.toDF("cluster", "c").join(F.broadcast(early.toDF("parent", "p"))).withColumn("similarity", cosine(F.col("c"), F.col("p")))
    parent = near.groupBy("cluster").agg(F.max_by("parent", F.struct("similarity", "parent")).alias("parent"), F.max("similarity").alias("similarity"))
    sib = late.toDF("cluster", "c").join(F.broadcast(late.toDF("other", "o"))).where("cluster <> other").groupBy("cluster").agg(F.max(cosine(F.col("c"), F.col("o"))).alias("sibling"))
    return parent.join(sib, "cluster", "left").select("cluster", "parent", "similarity", (F.col("similarity") <= F.greatest(F.coalesce("sibling", F.lit(sibling)), F.lit(sibling))).alias("born"))
