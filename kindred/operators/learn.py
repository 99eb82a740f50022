"""Training a match classifier on features, and its measures."""

from __future__ import annotations

from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LinearSVC, LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FEATURES = ["ngram1", "longest_com_sub", "levenshtein", "wordnet_sim", "word2vec_sim", "sim_v", "sim_h", "sim_i"]


def split(features: DataFrame, keys: list[str], train_percent: int = 70, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Training and test rows by a hash of the keys, so that copies of a pair stay together."""
    bucket = F.pmod(F.xxhash64(*keys, F.lit(seed)), F.lit(100))
    return features.where(bucket < train_percent), features.where(bucket >= train_percent)


def classifier(name: str, width: int, seed: int = 1):
    own = {"labelCol": "match", "featuresCol": "kd_features", "predictionCol": "predict"}
    models = {
        "DecisionTree": lambda: DecisionTreeClassifier(impurity="gini", maxDepth=30, seed=seed, **own),
        "XGBoost": lambda: GBTClassifier(maxIter=20, maxDepth=5, stepSize=0.1, subsamplingRate=0.7, featureSubsetStrategy="0.7", seed=seed, **own),
        "ANN": lambda: MultilayerPerceptronClassifier(layers=[width, 5, 2, 2], seed=seed, **own),
        "RandomForest": lambda: RandomForestClassifier(numTrees=100, seed=seed, **own),
        "LogisticRegression": lambda: LogisticRegression(**own),
        "SGDClassifier": lambda: LinearSVC(**own),
    }
    if name not in models:
        raise ValueError(f"unknown model {name}; known: {', '.join(models)}")
    return models[name]()


def fit_predict(train: DataFrame, test: DataFrame, model: str = "ANN", columns: list[str] = FEATURES) -> DataFrame:
    """test with predict, 0 or 1; missing features count 0."""
    assembler = VectorAssembler(inputCols=columns, outputCol="kd_features")
    ready = lambda df: assembler.transform(df.na.fill(0.0, columns)).withColumn("match", F.col("match").cast("double"))
    fitted = classifier(model, len(columns)).fit(ready(train))
    out = fitted.transform(ready(test))
    return out.select(*[c for c in test.columns if c != "match"], F.col("match").cast("int").alias("match"), F.col("predict").cast("int").alias("predict"))


def mappings(predicted: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Predicted, true and correct rows."""
    return predicted.where("predict = 1"), predicted.where("match = 1"), predicted.where("match = 1 and predict = 1")


def measures(predicted: DataFrame, keys: list[str] = []) -> DataFrame:  # noqa: B006
    """(keys, tp, n_pred, n_true, precision, recall, f1, f05, f2, swapped_precision, swapped_recall, odd_f05, odd_f2); null where a denominator is 0.

    The swapped and odd columns are the same figures under the names and weights in which an older script printed them.
    """
    hit = (F.col("match") == 1) & (F.col("predict") == 1)
    counts = predicted.groupBy(*keys).agg(F.count_if(hit).alias("tp"), F.count_if(F.col("predict") == 1).alias("n_pred"), F.count_if(F.col("match") == 1).alias("n_true"))
    p, r = F.try_divide(F.col("tp").cast("double"), F.col("n_pred").cast("double")), F.try_divide(F.col("tp").cast("double"), F.col("n_true").cast("double"))
    f = lambda b2: F.try_divide((1 + b2) * p * r, b2 * p + r)
    odd = lambda k: F.try_divide(k * p * r, k * r + p)
    return counts.select(
        *keys, "tp", "n_pred", "n_true", p.alias("precision"), r.alias("recall"), f(1.0).alias("f1"), f(0.25).alias("f05"), f(4.0).alias("f2"),
        r.alias("swapped_precision"), p.alias("swapped_recall"), odd(1.25).alias("odd_f05"), odd(5.0).alias("odd_f2"),
    )
