"""Probes: how well features tell two cohorts apart, over folds that keep an entity together.

Folds are hash buckets of the entity, so they don't depend on row order; scores are ranked in Spark (ties one half)."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .distribution import distances


def with_folds(df: DataFrame, entity: str, folds: int) -> DataFrame:
    return df.withColumn("fold", F.pmod(F.xxhash64(entity), F.lit(folds)).cast("int"))


def probe(df: DataFrame, features: list[str], label: str, entity: str, folds: int = 5, model: str = "linear", reg: float = 1e-3) -> DataFrame:
    """(fold, ks, auc) of a logistic ("linear") or boosted-tree ("trees") classifier of the 0/1 label. Each fold's scaling
    and model come from the other folds; one pass scores it. Missing features count as 0."""
    rows = with_folds(df, entity, folds).select("fold", F.col(label).cast("double").alias("y"), *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in features])
    rows = VectorAssembler(inputCols=features, outputCol="raw").transform(rows).select("fold", "y", "raw")
    out = None
    for k in range(folds):
        train, test = rows.where(F.col("fold") != k), rows.where(F.col("fold") == k)
        scaler = StandardScaler(inputCol="raw", outputCol="x", withMean=True).fit(train)
        m = LogisticRegression(featuresCol="x", labelCol="y", regParam=reg, maxIter=25) if model == "linear" else GBTClassifier(featuresCol="x", labelCol="y", maxIter=10, maxDepth=4, seed=1)
        scored = m.fit(scaler.transform(train)).transform(scaler.transform(test))
        s = scored.select("fold", "y", F.round(vector_to_array("probability")[1], 9).alias("p"))
        out = s if out is None else out.unionByName(s)
    return distances(out, "p", F.col("y") == 1, ["fold"]).select("fold", "ks", "auc")


def ablation(df: DataFrame, features: list[str], label: str, entity: str, folds: int = 2) -> DataFrame:
    """(kind, feature, auc): each feature alone, the best ones together as one after the other joins them (`cumulative`, in the order of
    their own scores, ties by name; the last is all of them), and all but one. A loop over features, each a Spark job."""

    def score(kind: str, name: str, cols: list[str]) -> tuple[str, str, float | None]:
        return kind, name, probe(df, cols, label, entity, folds).agg(F.avg("auc")).first()[0]

    rows = [score("alone", f, [f]) for f in features]
    best = [f for _, f, auc in sorted(rows, key=lambda r: (-(r[2] if r[2] is not None else -1.0), r[1]))]
    rows += [score("cumulative", best[k], best[: k + 1]) for k in range(1, len(best))]
    rows += [("all", "", rows[-1][2])] if len(features) > 1 else []
    rows += [score("without", f, [x for x in features if x != f]) for f in features if len(features) > 1]
    return df.sparkSession.createDataFrame(rows, "kind string, feature string, auc double")
