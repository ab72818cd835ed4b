"""Classifiers, scalers and splits on Spark ML."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import (
    LogisticRegression,
    MultilayerPerceptronClassifier,
    RandomForestClassifier,
)
from pyspark.ml.feature import PCA, IndexToString, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.operators.evaluation import min_max_scaled
from faultline.operators.patterns import PATTERNS
from faultline.operators.ranking import rank_within
from faultline.operators.scale import global_index

# fixed values
HIDDEN = [100]
EMBED_DIM = 128
FOLDS = 5
PATTERN_POINTS = 30


def assemble(df: DataFrame, columns: list[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=columns, outputCol=out, handleInvalid="keep").transform(df)


def forest(train: DataFrame, label: str, trees: int = 20, depth: int = 5, seed: int = 42):
    """Random forest on ``features``."""
    model = RandomForestClassifier(labelCol=label, featuresCol="features", numTrees=trees, maxDepth=depth, seed=seed)
    return model.fit(train)


def root_classifier(train: DataFrame, label: str, n_features: int, hidden: list[int] = HIDDEN, rounds: int = 30):
    """Perceptron from features to a text label; labels are remapped to a dense range and back."""
    indexer = StringIndexer(inputCol=label, outputCol="label_no", handleInvalid="skip").fit(train)
    net = MultilayerPerceptronClassifier(
        labelCol="label_no", featuresCol="features", maxIter=rounds, seed=42,
        layers=[n_features, *hidden, max(2, len(indexer.labels))],
    )
    back = IndexToString(inputCol="prediction", outputCol="predicted", labels=indexer.labels)
    return Pipeline(stages=[net, back]).fit(indexer.transform(train)), indexer.labels


def class_probability_sum(scored: DataFrame, labels: list[str], keys: list[str]) -> DataFrame:
    """Sum of class probabilities over the given traces, ranked per group."""
    cells = scored.select(*keys, F.posexplode(vector_to_array("probability")).alias("pos", "p"))
    names = F.array(*map(F.lit, labels))
    sums = cells.withColumn("service", F.get(names, F.col("pos"))).filter("service is not null")
    total = sums.groupBy(*keys, "service").agg(F.sum("p").alias("score"))
    return rank_within(total, keys, [F.desc("score"), "service"])


def reduced(train: DataFrame, rows: DataFrame, dim: int, pad: int = EMBED_DIM) -> DataFrame:
    """PCA then standard scaling, fitted once on all training rows, zero-padded to ``pad`` values."""
    pca = PCA(k=dim, inputCol="features", outputCol="_pca")
    scaler = StandardScaler(inputCol="_pca", outputCol="_scaled", withMean=True, withStd=True)
    model = Pipeline(stages=[pca, scaler]).fit(train)
    values = vector_to_array("_scaled")
    padded = F.concat(values, F.array_repeat(F.lit(0.0), F.lit(pad) - F.size(values)))
    return model.transform(rows).withColumn("embedding", padded).drop("_pca", "_scaled")


def reconstruction_errors(rows: DataFrame, train: Column, names: list[str], k: int) -> DataFrame:
    """Squared error per metric after projecting each step's vector on k principal directions.

    rows is (incident_id, k, z array) with one value per name; one model is fitted on the training
    steps of all incidents. The directions (names x k numbers) travel as literals.
    """
    vectors = rows.withColumn("features", array_to_vector("z"))
    model = PCA(k=k, inputCol="features", outputCol="_pc").fit(vectors.filter(train))
    pc = model.pc.toArray()
    projected = model.transform(vectors).withColumn("_p", vector_to_array("_pc"))
    cells = []
    for i, name in enumerate(names):
        back = sum((F.get("_p", F.lit(j)) * float(pc[i, j]) for j in range(k)), F.lit(0.0))
        gap = F.get("z", F.lit(i)) - back
        cells.append(F.struct(F.lit(name).alias("metric"), (gap * gap).alias("error")))
    return projected.select("incident_id", "k", train.alias("train"), F.inline(F.array(*cells)))


def synthetic_patterns(spark, per_class: int = 200, seed: int = 7) -> DataFrame:
    """Training windows of all 11 shape classes: a base level, noise and the class's own shape."""
    n = per_class * len(PATTERNS)
    rows = spark.range(n).select(
        "id",
        (F.col("id") % len(PATTERNS)).alias("class_no"),
        (F.rand(seed) * 10 + 5).alias("base"),
        (F.rand(seed + 1) * 4 + 2).alias("size"),
        F.floor(F.rand(seed + 2) * 12 + 9).cast("int").alias("at"),
        F.explode(F.sequence(F.lit(0), F.lit(PATTERN_POINTS - 1))).alias("k"),
    )
    k, at, c = F.col("k"), F.col("at"), F.col("class_no")
    sign = F.when(c.isin(1, 3, 5, 7, 9), -1).otherwise(1)
    shape = (
        F.when(c.isin(0, 1), (k >= at).cast("double"))
        .when(c.isin(2, 3), k / (PATTERN_POINTS - 1))
        .when(c.isin(4, 5), (k == at).cast("double"))
        .when(c.isin(6, 7), ((k >= at) & (k < at + 5)).cast("double"))
        .when(c.isin(8, 9), (k % 7 == at % 7).cast("double"))
        .otherwise(F.sin(k * 2.1))
    )
    noise = F.randn(seed + 3) * 0.15
    return rows.select("id", "class_no", "k", (F.col("base") + sign * F.col("size") * shape + noise).alias("value"))


def window_vectors(windows: DataFrame, keys: list[str]) -> DataFrame:
    """30 min-max scaled values per window, as features."""
    points = windows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("k", "value")))["value"].alias("v"))
    filled = F.transform("v", lambda x: F.coalesce(x, F.lit(0.0)))
    return min_max_scaled(points, "v").select(*keys, array_to_vector(filled).alias("features"))


def stratified_folds(rows: DataFrame, label: str, key: str, folds: int = FOLDS, seed: int = 42) -> DataFrame:
    """Fold number per row, balanced inside every label by a hash of the key.

    Rows are numbered in (label, hash) order over all tasks, so a label with most rows is no problem.
    """
    shuffled = rows.withColumn("_h", F.xxhash64(F.lit(seed), key))
    return global_index(shuffled, [label, "_h", key], "_i").withColumn("fold", F.col("_i") % folds).drop("_h", "_i")


def cross_validate(rows: DataFrame, make_model, label: str, folds: int = FOLDS) -> DataFrame:
    """Held-out predictions of every fold; each model sees the other folds only."""
    rows = rows.persist()
    out = None
    for fold in range(folds):
        model = make_model(rows.filter(F.col("fold") != fold))
        held = model.transform(rows.filter(F.col("fold") == fold)).select("fold", label, "prediction")
        out = held if out is None else out.unionByName(held)
    return out


def majority_share(rows: DataFrame, label: str) -> DataFrame:
    """Accuracy of always answering the most frequent label."""
    counts = rows.groupBy(label).agg(F.count("*").alias("c"))
    return counts.agg((F.max("c") / F.sum("c")).alias("majority"))


def logistic(train: DataFrame, label: str):
    return LogisticRegression(labelCol=label, featuresCol="features", maxIter=50, regParam=0.01).fit(train)


def time_tail(rows: DataFrame, order: list, n: int = 40) -> DataFrame:
    """Split: the last n rows in time are ``tail``, the others ``train``."""
    last = rows.orderBy(*[F.desc(c) for c in order]).limit(n).select(*order)
    marked = rows.join(last.withColumn("_t", F.lit(True)), order, "left")
    return marked.withColumn("split", F.when(F.col("_t"), "tail").otherwise("train")).drop("_t")
