"""Model-level jobs (M*): multi-label logistic regression trained with MLlib
per label on the non-null cells, batch scoring, and fold ensembles.

Training data stay distributed: MLlib aggregates gradients over partitions;
only the fitted coefficients (labels x features) reach the driver.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import logit, sigmoid


def fit_multilabel_logreg(features: DataFrame, labels: DataFrame, alpha: float = 1e-3,
                          max_iter: int = 50, tol: float = 1e-6, vec: str = "vec") -> dict:
    """M1: one ridge-regularised logistic regression per label on the rows
    whose label is not null (null masking).  ``features``: (entry, vec ARRAY);
    ``labels``: long (entry, label_id, y) with y in {0, 1} (null cells absent).
    Returns {label_id: fitted model}."""
    x = features.select("entry", array_to_vector(vec).alias("features"))
    label_ids = [r[0] for r in labels.select("label_id").distinct().orderBy("label_id").collect()]
    models = {}
    for lid in label_ids:
        d = (labels.where(F.col("label_id") == lid).select("entry", F.col("y").cast("double").alias("label"))
             .join(x, "entry"))
        lr = LogisticRegression(regParam=alpha, elasticNetParam=0.0, maxIter=max_iter, tol=tol,
                                standardization=False)
        models[lid] = lr.fit(d)
    return models


def fit_multilabel_gbt(features: DataFrame, labels: DataFrame, label_ids: list | None = None, max_iter: int = 20,
                      max_depth: int = 4, seed: int = 42, vec: str = "vec") -> dict:
    """M2: boosted trees for the selected labels (default: every label of the table), each trained on the rows
    whose label is not null (MLlib GBT: trees are grown from distributed
    histogram aggregates)."""
    x = features.select("entry", array_to_vector(vec).alias("features"))
    if label_ids is None:
        label_ids = [r[0] for r in labels.select("label_id").distinct().orderBy("label_id").collect()]
    models = {}
    for lid in label_ids:
        d = (labels.where(F.col("label_id") == lid).select("entry", F.col("y").cast("double").alias("label"))
             .join(x, "entry"))
        models[lid] = GBTClassifier(maxIter=max_iter, maxDepth=max_depth, seed=seed).fit(d)
    return models


def score_multilabel(models: dict, features: DataFrame, vec: str = "vec") -> DataFrame:
    """M3: batch scoring of every entry by every label model -> long
    (entry, label_id, prob); runs as MLlib transforms (JVM side)."""
    x = features.select("entry", array_to_vector(vec).alias("features"))
    out = None
    for lid, m in models.items():
        s = m.transform(x).select("entry", F.lit(lid).alias("label_id"),
                                  vector_to_array("probability").getItem(1).alias("prob"))
        out = s if out is None else out.unionByName(s)
    return out


def fold_ensemble(fold_preds: list[DataFrame], how: str = "logit", key=("entry", "term"),
                  value: str = "prob") -> DataFrame:
    """M4: combine the predictions of k fold models -- mean of logits then
    sigmoid (``how='logit'``) or the mean of probabilities (``'prob'``); a
    pair missing from a fold is averaged over the folds that have it."""
    u = None
    for i, p in enumerate(fold_preds):
        t = p.select(*key, F.col(value).alias("_p"))
        u = t if u is None else u.unionByName(t)
    if how == "logit":
        return u.groupBy(*key).agg(sigmoid(F.avg(logit("_p"))).alias(value))
    return u.groupBy(*key).agg(F.avg("_p").alias(value))
