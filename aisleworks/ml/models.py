"""Spark ML fits: calibrated classifier, recursive forecast, segments, association rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.fpm import FPGrowth
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, IsotonicRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aisleworks.operators.pricing import cases
from aisleworks.session import keep_checkpoints

SEED = 42


def assemble(features: Sequence[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="keep")


def filled(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return df.withColumns({f: F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features})


# --- calibrated binary classifier ---


def calibrated_scores(
    train: DataFrame, calibration: DataFrame, score: DataFrame, features: Sequence[str], label: str, *, iterations: int, depth: int = 4, bins: int = 10_000
) -> DataFrame:
    """``score`` with a calibrated ``probability``.

    The isotonic fit ends on one node, so it gets calibration rows summed into at most
    ``bins`` score bins with their weights.
    """
    model = Pipeline(stages=[
        assemble(features), GBTClassifier(labelCol=label, featuresCol="features", maxIter=iterations, maxDepth=depth, seed=SEED, cacheNodeIds=False),
    ]).fit(filled(train, features))

    def raw(df):
        scored = model.transform(filled(df, features))
        p = vector_to_array("probability")[1]
        return scored.withColumn("raw_score", p).drop("features", "rawPrediction", "probability", "prediction")

    binned = (
        raw(calibration).groupBy((F.floor(F.col("raw_score") * bins) / bins).alias("bin"))
        .agg(F.avg(F.col(label).cast("double")).alias("label"), F.count(F.lit(1)).cast("double").alias("weight"))
    )
    iso = IsotonicRegression(featuresCol="bin", labelCol="label", weightCol="weight").fit(binned)
    scored = raw(score).withColumn("bin", F.floor(F.col("raw_score") * bins) / bins)
    return iso.transform(scored).withColumnRenamed("prediction", "probability").drop("bin")


def risk_band(probability: Column, bands: Sequence[tuple[float, str]], lowest: str) -> Column:
    return cases(*[(probability >= limit, name) for limit, name in bands], default=lowest)


# --- recursive demand forecast ---

HISTORY = 28
DEMAND_FEATURES = ["lag_1", "lag_7", "lag_14", "lag_28", "mean_7", "mean_14", "mean_28", "std_14", "day_of_week", "day_of_month", "month", "week_of_year", "is_weekend"]


def history_state(series: DataFrame, keys: Sequence[str], date: str, value: str, origin: Column) -> DataFrame:
    """Per key the last 28 daily values up to ``origin`` as one array: all that forecasting needs."""
    recent = series.where((F.col(date) > F.date_sub(origin, HISTORY)) & (F.col(date) <= origin))
    steps = F.sort_array(F.collect_list(F.struct(F.col(date).alias("d"), F.col(value).cast("double").alias("v"))))
    return (
        recent.groupBy(*keys).agg(steps.alias("_s")).where(F.size("_s") == HISTORY)
        .select(*keys, F.transform("_s", lambda x: x["v"]).alias("history"), origin.alias("origin"))
    )


def history_features(df: DataFrame, date: Column) -> DataFrame:
    """The training features, computed from the history array instead of neighbouring rows."""
    h = F.col("history")
    tail = lambda n: F.slice(h, HISTORY - n + 1, n)
    mean = lambda n: F.aggregate(tail(n), F.lit(0.0), lambda a, x: a + x) / F.lit(float(n))
    squares = F.aggregate(F.transform(tail(14), lambda x: (x - F.col("mean_14")) * (x - F.col("mean_14"))), F.lit(0.0), lambda a, x: a + x)
    out = df.withColumns({f"lag_{n}": F.element_at(h, -n) for n in (1, 7, 14, 28)} | {f"mean_{n}": mean(n) for n in (7, 14, 28)})
    dow = F.dayofweek(date)
    return out.withColumns({
        "std_14": F.sqrt(squares / F.lit(13.0)), "day_of_week": dow, "day_of_month": F.dayofmonth(date), "month": F.month(date),
        "week_of_year": F.weekofyear(date), "is_weekend": F.when(dow.isin(1, 7), 1).otherwise(0),
    })


def fit_demand(training: DataFrame, label: str, *, iterations: int, depth: int = 6):
    regressor = GBTRegressor(labelCol=label, featuresCol="features", maxIter=iterations, maxDepth=depth, stepSize=0.1, subsamplingRate=0.8, seed=SEED)
    return Pipeline(stages=[assemble(DEMAND_FEATURES), regressor]).fit(filled(training, DEMAND_FEATURES))


def recursive_forecast(model, state: DataFrame, keys: Sequence[str], horizon: int) -> DataFrame:
    """Forecast step by step; each prediction becomes part of the next step's history.

    A step is a projection over one row per series: no join, no shuffle, no growing union.
    """
    steps = []
    current = state
    for step in range(1, horizon + 1):
        ready = filled(history_features(current, F.date_add("origin", step)), DEMAND_FEATURES)
        predicted = model.transform(ready).withColumn("predicted", F.greatest(F.col("prediction"), F.lit(0.0)))
        steps.append(f"units_{step}")
        current = predicted.select(
            *keys, "origin", *steps[:-1], F.col("predicted").alias(steps[-1]),
            F.concat(F.slice("history", 2, HISTORY - 1), F.array("predicted")).alias("history"),
        )
    long = F.explode(F.array(*[F.struct(F.lit(i + 1).alias("step"), F.col(c).alias("predicted_units")) for i, c in enumerate(steps)]))
    return current.select(*keys, "origin", long.alias("_f")).select(
        *keys, "origin", F.col("_f.step").alias("step"), F.date_add("origin", F.col("_f.step")).alias("forecast_date"), F.col("_f.predicted_units").alias("predicted_units")
    )


# --- dwell regression ---


def dwell_predictions(train: DataFrame, calibration: DataFrame, score: DataFrame, numeric: Sequence[str], category: str, label: str, *, iterations: int, coverage: float = 0.8) -> DataFrame:
    """Dwell with an interval of the wanted coverage from absolute calibration residuals.

    Each round of boosting stands on the errors of the one before; every tenth is checkpointed.
    """
    keep_checkpoints(train.sparkSession)
    model = Pipeline(stages=[
        StringIndexer(inputCol=category, outputCol="_category", handleInvalid="keep"), assemble([*numeric, "_category"]),
        GBTRegressor(labelCol=label, featuresCol="features", maxIter=iterations, maxDepth=5, stepSize=0.05, subsamplingRate=0.8, maxBins=64, seed=SEED),
    ]).fit(filled(train, numeric))
    held = model.transform(filled(calibration, numeric))
    width = held.agg(F.percentile_approx(F.abs(F.col(label) - F.col("prediction")), F.lit(coverage), F.lit(10_000)).alias("w")).scalar()
    p = F.greatest(F.col("prediction"), F.lit(0.0))
    return model.transform(filled(score, numeric)).withColumn("predicted_dwell", p).withColumns(
        {"lower_bound": F.greatest(p - width, F.lit(0.0)), "upper_bound": p + width}
    ).drop("features", "_category", "prediction")


# --- segments ---


def kmeans_segments(rfm: DataFrame, features: Sequence[str], *, ks: Sequence[int]) -> DataFrame:
    """Clusters with the best silhouette (ties: fewer clusters) and ids in centroid order.

    Centroids are at most ``max(ks)`` rows, so ordering them on the driver is bounded.
    """
    scaled = Pipeline(stages=[
        VectorAssembler(inputCols=list(features), outputCol="_raw"), StandardScaler(inputCol="_raw", outputCol="features", withMean=True, withStd=True),
    ]).fit(rfm).transform(rfm).persist()
    evaluator = ClusteringEvaluator(featuresCol="features", predictionCol="prediction")
    best = None
    for k in ks:
        model = KMeans(k=k, seed=SEED, featuresCol="features").fit(scaled)
        quality = evaluator.evaluate(model.transform(scaled))
        if best is None or quality > best[0] + 1e-12:
            best = (quality, k, model)
    quality, k, model = best
    rank = {old: new for new, (_, old) in enumerate(sorted((tuple(float(x) for x in c), i) for i, c in enumerate(model.clusterCenters())))}
    lookup = F.array(*[F.lit(rank[i]) for i in range(k)])
    out = model.transform(scaled).withColumn("cluster_id", lookup[F.col("prediction")])
    return out.drop("_raw", "features", "prediction").withColumns({"silhouette": F.lit(quality), "clusters": F.lit(k)})


#: A segment whose members bought nothing for longer, on average, is lost.
LOST_AFTER_DAYS = 180


def segment_labels(clustered: DataFrame, *, recency: str, frequency: str, monetary: str) -> DataFrame:
    """Add ``segment_label``, named by where a cluster's means lie among all customers' thirds.

    The thirds are percentiles of the customers at 0.33 and 0.67, from a sketch with an error in
    rank of at most one in ten thousand. Clusters are few, so their labels are broadcast.
    """
    thirds = clustered.agg(*[F.percentile_approx(c, [0.33, 0.67], 10_000).alias(f"_t_{c}") for c in (recency, frequency, monetary)])
    means = clustered.groupBy("cluster_id").agg(*[F.avg(c).alias(f"_m_{c}") for c in (recency, frequency, monetary)])

    def score(c: str, low_is_good: bool) -> Column:
        mean, low, high = F.col(f"_m_{c}"), F.col(f"_t_{c}")[0], F.col(f"_t_{c}")[1]
        if low_is_good:
            return F.when(mean < low, 3).when(mean < high, 2).otherwise(1)
        return F.when(mean > high, 3).when(mean > low, 2).otherwise(1)

    r, f, m = F.col("_r"), F.col("_f"), F.col("_v")
    label = (
        F.when((r == 3) & (f == 3) & (m == 3), "Champions")
        .when((r == 3) & (f >= 2) & (m >= 2), "Loyal Customers")
        .when((r == 3) & (f <= 2) & (m <= 2), "New Customers")
        .when((r == 2) & (f >= 2) & (m >= 2), "Potential Loyalists")
        .when(r == 2, "At Risk")
        .when((r == 1) & (F.col(f"_m_{recency}") > LOST_AFTER_DAYS), "Lost")
        .otherwise("Hibernating")
    )
    scored = means.join(F.broadcast(thirds)).withColumns({"_r": score(recency, True), "_f": score(frequency, False), "_v": score(monetary, False)})
    return clustered.join(F.broadcast(scored.select("cluster_id", label.alias("segment_label"))), "cluster_id")


# --- market basket ---


def association_rules(baskets: DataFrame, *, support: float, confidence: float, top: int | None = None) -> DataFrame:
    """One-to-one rules by lift, support and names."""
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(baskets)
    single = model.associationRules.where((F.size("antecedent") == 1) & (F.size("consequent") == 1))
    rules = (
        single.select(F.col("antecedent")[0].alias("antecedent"), F.col("consequent")[0].alias("consequent"), "confidence", "lift", "support")
        .orderBy(F.desc("lift"), F.desc("support"), "antecedent", "consequent")
    )
    return rules if top is None else rules.limit(top)


def recommendations(rules: DataFrame, per_item: int) -> DataFrame:
    w = Window.partitionBy("antecedent").orderBy(F.desc("lift"), F.desc("confidence"), "consequent")
    return rules.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= per_item)
