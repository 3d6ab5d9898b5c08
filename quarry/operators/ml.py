"""Learned operators on JVM-side Spark ML: forest, mixture, components."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.clustering import GaussianMixture, KMeans
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.sections import zscore


#: The features of a window, in the order of the model.
LITHOLOGY_FEATURES = ["gr_mean", "gr_std", "rt_mean", "den_mean", "cnl_mean", "gr_slope", "thickness", "rt_den"]
#: Fixed values: (class, GR mean and deviation, RT mean and deviation, DEN mean and deviation, CNL mean and
#: deviation, mean thickness, GR deviation inside mean and deviation, slope mean and deviation) of the classes.
LITHOLOGY_CLASSES = [
    ("shale", 105, 15, 4, 2, 2.58, 0.08, 0.28, 0.06, 30, 2, 1, 2, 1.5),
    ("silty_sandstone", 60, 12, 8, 4, 2.45, 0.06, 0.20, 0.05, 15, 5, 2, 2, 1.5),
    ("clean_sandstone", 35, 8, 40, 20, 2.30, 0.05, 0.15, 0.04, 20, 4, 2, 2, 1.5),
    ("carbonate", 25, 10, 100, 50, 2.65, 0.05, 0.05, 0.03, 10, 5, 2, 3, 2),
    ("coal", 20, 8, 500, 200, 1.65, 0.10, 0.40, 0.05, 3, 3, 1, 3, 2),
    ("organic_rich_shale", 130, 20, 25, 10, 2.50, 0.06, 0.25, 0.06, 25, 10, 4, 3, 2.5),
]


def training_samples(spark: SparkSession, each: int = 500, seed: int = 42) -> DataFrame:
    """``label`` and the features of ``each`` made windows of every class, drawn from its distributions."""
    fields = ["name", "gr", "gr_sd", "rt", "rt_sd", "den", "den_sd", "cnl", "cnl_sd", "thick", "in_m", "in_sd", "sl_m", "sl_sd"]
    table = F.array(*[F.struct(F.lit(float(k)).alias("label"), *[F.lit(float(v) if f != "name" else v).alias(f) for f, v in zip(fields, c, strict=True)]) for k, c in enumerate(LITHOLOGY_CLASSES)])
    rows = spark.range(each * len(LITHOLOGY_CLASSES), numPartitions=1).select(F.element_at(table, (F.floor(F.col("id") / each) + 1).cast("int")).alias("c"))
    draw = lambda mean, sd, k: F.col(f"c.{mean}") + F.col(f"c.{sd}") * F.randn(seed + k)
    rt, den = F.greatest(draw("rt", "rt_sd", 1), F.lit(0.1)), draw("den", "den_sd", 2)
    out = rows.select("c.label", draw("gr", "gr_sd", 0).alias("gr_mean"), F.abs(draw("in_m", "in_sd", 3)).alias("gr_std"), rt.alias("rt_mean"), den.alias("den_mean"), draw("cnl", "cnl_sd", 4).alias("cnl_mean"), F.abs(draw("sl_m", "sl_sd", 5)).alias("gr_slope"), (-F.col("c.thick") * F.log(1 - F.rand(seed + 6))).alias("thickness"))
    return out.withColumn("rt_den", F.col("rt_mean") / F.greatest(F.col("den_mean"), F.lit(1e-8)))


@dataclass
class LithologyModel:
    """Scaler and forest of window features; class numbers are places in ``LITHOLOGY_CLASSES``."""

    fitted: PipelineModel

    @classmethod
    def train(cls, samples: DataFrame, trees: int = 100, depth: int = 10) -> LithologyModel:
        stages = [VectorAssembler(inputCols=LITHOLOGY_FEATURES, outputCol="_raw"), StandardScaler(inputCol="_raw", outputCol="_x", withMean=True), RandomForestClassifier(featuresCol="_x", labelCol="label", numTrees=trees, maxDepth=depth, seed=42)]
        return cls(Pipeline(stages=stages).fit(samples))

    def save(self, path: str) -> None:
        self.fitted.write().overwrite().save(path)

    @classmethod
    def load(cls, path: str) -> LithologyModel:
        return cls(PipelineModel.load(path))

    def predict(self, rows: DataFrame) -> DataFrame:
        """Adds ``lithology`` and ``confidence``, the largest class probability."""
        from pyspark.ml.functions import vector_to_array

        names = F.array(*[F.lit(c[0]) for c in LITHOLOGY_CLASSES])
        out = self.fitted.transform(rows)
        return out.withColumn("confidence", F.array_max(vector_to_array("probability"))).withColumn("lithology", F.element_at(names, F.col("prediction").cast("int") + 1)).select(*rows.columns, "lithology", "confidence")


_DEFAULT: dict[str, LithologyModel] = {}


def default_lithology(spark: SparkSession) -> LithologyModel:
    """The model of the made windows, trained once a session."""
    key = spark.sparkContext.applicationId
    if key not in _DEFAULT:
        _DEFAULT[key] = LithologyModel.train(training_samples(spark))
    return _DEFAULT[key]


def train_lithology(samples: DataFrame, features: list[str], label: str = "label", trees: int = 100, depth: int = 10) -> RandomForestClassificationModel:
    """The forest of labelled feature rows."""
    data = VectorAssembler(inputCols=features, outputCol="x").transform(samples)
    return RandomForestClassifier(featuresCol="x", labelCol=label, numTrees=trees, maxDepth=depth, seed=42).fit(data)


def predict_lithology(model: RandomForestClassificationModel, rows: DataFrame, features: list[str]) -> DataFrame:
    """Adds ``class_id`` and ``confidence``, the largest class probability."""
    from pyspark.ml.functions import vector_to_array

    out = model.transform(VectorAssembler(inputCols=features, outputCol="x").transform(rows))
    return out.withColumn("confidence", F.array_max(vector_to_array("probability"))).withColumn("class_id", F.col("prediction").cast("int")).drop("x", "rawPrediction", "probability", "prediction")


def cluster_facies(rows: DataFrame, features: list[str], clusters: int = 4, method: str = "gmm") -> DataFrame:
    """Adds ``cluster_id``: z-scores, three components of more than two features, mixture or k-means."""
    own = [F.col(f).alias(f"_own_{f}") for f in features]
    data = VectorAssembler(inputCols=features, outputCol="x").transform(zscore(rows.select("*", *own), features))
    data = data.drop(*features).withColumnsRenamed({f"_own_{f}": f for f in features})
    if len(features) > 2:
        data = PCA(k=min(len(features), 3), inputCol="x", outputCol="pc").fit(data).transform(data).drop("x").withColumnRenamed("pc", "x")
    kind = GaussianMixture(featuresCol="x", k=clusters, seed=0) if method == "gmm" else KMeans(featuresCol="x", k=clusters, seed=0)
    return kind.fit(data).transform(data).withColumn("cluster_id", F.col("prediction").cast("int")).drop("x", "prediction", "probability")


def cluster_profile(rows: DataFrame, cluster: str, features: list[str], least: int = 10) -> DataFrame:
    """Size, feature means and the feature of largest magnitude of each cluster of ``least`` rows."""
    means = rows.groupBy(cluster).agg(F.count("*").alias("area"), *[F.avg(f).alias(f) for f in features]).where(F.col("area") >= least)
    best = F.greatest(*[F.struct(F.abs(f).alias("v"), F.lit(f).alias("n")) for f in features])["n"]
    return means.withColumn("dominant", best)
