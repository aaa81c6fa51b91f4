"""Classifier evaluation and model fitting (fairness tables, pyspark.ml fits).

Confusion counts are conditional sums in one aggregate per group; model
fitting is ``pyspark.ml`` (distributed training), never a local library.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# B26 / B27 ------------------------------------------------------------------
def confusion(df: DataFrame, y: str, p: str, by: Sequence[str] = ()) -> DataFrame:
    """2x2 counts m{true}{pred} and accuracy, optionally per protected group."""
    yy, pp = _c(y).cast("int"), _c(p).cast("int")
    g = df.groupBy(*by).agg(
        F.count_if((yy == 0) & (pp == 0)).alias("m00"), F.count_if((yy == 0) & (pp == 1)).alias("m01"),
        F.count_if((yy == 1) & (pp == 0)).alias("m10"), F.count_if((yy == 1) & (pp == 1)).alias("m11"),
        F.count(F.lit(1)).alias("n"))
    return g.withColumn("accuracy", F.round((F.col("m00") + F.col("m11")) / F.col("n"), 6))


# B28 ------------------------------------------------------------------------
def fairness(conf: DataFrame) -> DataFrame:
    """Per group, the harness's label-0-oriented formulas and the textbook ones.

    parity = m00 + m11; "TPR" = m00 / (m00 + m10); "FNR" = m10 / (m10 + m00);
    textbook TPR = m11 / (m11 + m10), FNR = m10 / (m10 + m11).
    """
    def ratio(a, b):
        return F.round(F.try_divide(a.cast("double"), b.cast("double")), 6)
    m00, m01, m10, m11 = (F.col(c) for c in ("m00", "m01", "m10", "m11"))
    return conf.select("*", (m00 + m11).alias("parity"), ratio(m00, m00 + m10).alias("tpr_ref"),
                       ratio(m10, m10 + m00).alias("fnr_ref"), ratio(m11, m11 + m10).alias("tpr"),
                       ratio(m10, m10 + m11).alias("fnr"))


# features -------------------------------------------------------------------
def assemble(df: DataFrame, cols: Sequence[str], out: str = "features") -> DataFrame:
    from pyspark.ml.feature import VectorAssembler
    return VectorAssembler(inputCols=list(cols), outputCol=out, handleInvalid="keep").transform(df)


def balanced_weights(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """``class_weight='balanced'``: n / (k * n_class) per row, from one aggregate."""
    # one aggregate job; the class table (one row per class) is the broadcast side
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_nc")).collect()
    tot, k = sum(r["_nc"] for r in counts), len(counts)
    w = F.create_map(*[x for r in counts for x in (F.lit(r[label]), F.lit(tot / (k * r["_nc"])))])
    return df.withColumn(out, w[F.col(label)])


# B22 - B25 ------------------------------------------------------------------
def _fit(estimator, train: DataFrame):
    """Fit with the training frame persisted (memory, spilling to disk):
    iterative trainers scan it once per iteration, and the features come from
    joins that must not be recomputed each time."""
    from pyspark import StorageLevel
    t = train.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        model = estimator.fit(t)
    finally:
        t.unpersist()
    # a copy carries no training summary (which holds the session and would be
    # captured by every transform closure)
    return model.copy()


def gaussian_nb(train: DataFrame, test: DataFrame, label: str, features: str = "features") -> DataFrame:
    from pyspark.ml.classification import NaiveBayes
    m = _fit(NaiveBayes(modelType="gaussian", labelCol=label, featuresCol=features), train)
    return m.transform(test)


def random_forest(train: DataFrame, test: DataFrame, label: str, features: str = "features",
                  weight: str | None = "weight", depth: int = 2, seed: int = 42, trees: int = 100) -> DataFrame:
    from pyspark.ml.classification import RandomForestClassifier
    kw = {"weightCol": weight} if weight else {}
    m = _fit(RandomForestClassifier(labelCol=label, featuresCol=features, maxDepth=depth, numTrees=trees, seed=seed, **kw), train)
    return m.transform(test)


def linear_svm(train: DataFrame, test: DataFrame, label: str, features: str = "features",
               weight: str | None = "weight", max_iter: int = 100) -> DataFrame:
    """Balanced linear SVM (:func:`rbf_svm` has the Gaussian kernel)."""
    from pyspark.ml.classification import LinearSVC
    kw = {"weightCol": weight} if weight else {}
    m = _fit(LinearSVC(labelCol=label, featuresCol=features, maxIter=max_iter, **kw), train)
    return m.transform(test)


def kernel_features(df: DataFrame, features: str, out: str, gamma: float, size: int = 256, seed: int = 42) -> DataFrame:
    """``df`` with ``out``: random Fourier features of the vector column ``features``, whose inner products approximate
    the Gaussian kernel exp(-gamma |x - y|^2) (error about 1 / sqrt(``size``)). Directions and phases come from ``seed``
    alone, so training and test rows, and repeated tasks, get the same ones. A null vector stays null; vectors of several
    lengths fail the job."""
    from pyspark.ml.functions import array_to_vector, vector_to_array

    from evalspark.functions.udfs import fourier_features

    return df.withColumn(out, array_to_vector(fourier_features(gamma, size, seed)(vector_to_array(F.col(features)))))


def kernel_width(train: DataFrame, features: str) -> float:
    """1 / (number of features x variance of all their values): one row of sums over the training rows."""
    from pyspark.ml.functions import vector_to_array

    values = train.select(F.explode(vector_to_array(F.col(features))).alias("x"))
    size = train.select(F.size(vector_to_array(F.col(features))).alias("n")).agg(F.max("n")).first()[0]
    var = values.agg(F.var_pop("x")).first()[0]
    return 1.0 / (size * var) if size and var else 1.0


def rbf_svm(train: DataFrame, test: DataFrame, label: str, features: str = "features", weight: str | None = "weight",
            max_iter: int = 100, gamma: float | None = None, size: int = 256, seed: int = 42) -> DataFrame:
    """Balanced SVM with a Gaussian kernel: a linear one on ``kernel_features``. ``gamma`` defaults to
    :func:`kernel_width` of the training rows. Columns of ``test`` stay, ``prediction`` and ``rawPrediction`` come."""
    g = gamma if gamma is not None else kernel_width(train, features)
    new = "_kernel_features"
    fitted = linear_svm(kernel_features(train, features, new, g, size, seed), kernel_features(test, features, new, g, size, seed), label, new, weight, max_iter)
    return fitted.drop(new)


def linear_reg(train: DataFrame, test: DataFrame, label: str, features: str = "features") -> DataFrame:
    from pyspark.ml.regression import LinearRegression
    m = _fit(LinearRegression(labelCol=label, featuresCol=features), train)
    return m.transform(test)


def simple_regression(df: DataFrame, y: str, x: str, by: Sequence[str] = ()) -> DataFrame:
    """One-feature least squares as aggregates (``regr_slope`` / ``regr_intercept``)."""
    return df.groupBy(*by).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"),
                               F.count(F.lit(1)).alias("n"))


# B15 / B17 ------------------------------------------------------------------
def pca_whiten(df: DataFrame, vec: str, k: int = 10) -> DataFrame:
    """k principal components, then standardised (mean 0, unit variance); signs are arbitrary."""
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array
    d = df.withColumn("_v", array_to_vector(F.col(vec).cast("array<double>")))
    p = _fit(PCA(k=k, inputCol="_v", outputCol="_pc"), d).transform(d)
    s = _fit(StandardScaler(withMean=True, withStd=True, inputCol="_pc", outputCol="_z"), p).transform(p)
    return s.withColumn("components", vector_to_array("_z")).drop("_v", "_pc", "_z")


def kmeans(df: DataFrame, vec: str, k: int = 5, seed: int = 42) -> tuple[DataFrame, list]:
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector
    d = df.withColumn("_v", array_to_vector(F.col(vec).cast("array<double>")))
    m = _fit(KMeans(k=k, seed=seed, featuresCol="_v", predictionCol="cluster"), d)
    return m.transform(d).drop("_v"), [list(c) for c in m.clusterCenters()]
