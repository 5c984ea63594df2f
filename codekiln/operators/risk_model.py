"""The tabular risk model: synthetic rows, stratified split, forest, causes of a prediction."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import IndexToString, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.pipeline import Pipeline
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codekiln.operators.text_features import FEATURE_COLUMNS, with_risk

#: Greatest value of each feature in the low, middle and high tier of synthetic rows; features not listed are sums or 0..3.
TIERS = {"loops_for": (2, 4, 8), "loops_while": (1, 2, 4), "nesting_max_depth": (1, 3, 6), "recursion_count": (0, 1, 3), "alloc_heap_new": (1, 3, 6), "alloc_heap_delete": (1, 2, 4), "complexity_time_rank": (2, 4, 6), "complexity_space_rank": (1, 3, 5), "semantic_high_severity_count": (0, 1, 3), "code_smell_high_severity_count": (0, 1, 2)}


def synthetic_rows(spark: SparkSession, n: int, seed: int = 42) -> DataFrame:
    """n rows of the feature columns, 40, 35 and 25 percent in the three tiers, the same for every run and partitioning."""
    rows = spark.range(n)
    uniform = lambda name: F.pmod(F.xxhash64(F.lit(seed), "id", F.lit(name)), F.lit(1_000_000)) / 1_000_000.0
    rows = rows.withColumn("tier", F.when(uniform("tier") < 0.4, 0).when(uniform("tier") < 0.75, 1).otherwise(2))

    def value(name: str) -> Column:
        most = TIERS.get(name, (1, 2, 3))
        return F.floor(uniform(name) * (F.when(F.col("tier") == 0, most[0]).when(F.col("tier") == 1, most[1]).otherwise(most[2]) + 1)).cast("double")

    rows = rows.withColumns({c: value(c) for c in FEATURE_COLUMNS})
    total = lambda *names: sum((F.col(n) for n in names), F.lit(0.0))
    return rows.withColumn("loops_total", total("loops_for", "loops_while", "loops_do_while", "loops_range_for")).withColumn("alloc_total", total("alloc_heap_new", "alloc_heap_delete", "alloc_malloc_family", "alloc_free_calls", "alloc_stack_arrays")).drop("tier")


def stratified_split(rows: DataFrame, key: str, label: str, share: float = 0.2, seed: int = 42) -> DataFrame:
    """rows with is_test: of each label the share with the smallest hashes of the key, to within a row.

    Ranks within a label are taken bucket by bucket of the hash: counts of buckets
    give each its offset, so a label with very many rows is never sorted in one task.
    """
    hashed = rows.withColumn("h", F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 40))).withColumn("bucket", F.shiftright("h", 30))
    counts = hashed.groupBy(label, "bucket").agg(F.count("*").alias("c"))
    own = Window.partitionBy(label).orderBy("bucket")
    offsets = counts.select(label, "bucket", (F.sum("c").over(own.rowsBetween(Window.unboundedPreceding, 0)) - F.col("c")).alias("offset"), F.sum("c").over(Window.partitionBy(label)).alias("n"))
    placed = hashed.join(offsets.withColumnRenamed(label, "label_2"), (F.col(label).eqNullSafe(F.col("label_2"))) & (hashed.bucket == offsets.bucket)).drop(offsets.bucket).drop("label_2")
    rank = F.row_number().over(Window.partitionBy(label, "bucket").orderBy("h", key)) + F.col("offset")
    return placed.withColumn("rank", rank).withColumn("is_test", F.col("rank") <= F.floor(F.col("n") * share + 0.5)).drop("h", "bucket", "offset", "n", "rank")


def fit_forest(rows: DataFrame, label: str, features: list[str] = FEATURE_COLUMNS, trees: int = 300, seed: int = 42) -> PipelineModel:
    """A forest with classes weighted against their sizes. Rows with a null label are left out."""
    rows = rows.filter(F.col(label).isNotNull())
    sizes = rows.groupBy(label).agg(F.count("*").alias("c"))
    total = sizes.agg(F.sum("c").alias("n"), F.count("*").alias("k")).first()
    weights = sizes.select(label, (F.lit(float(total["n"])) / (F.lit(total["k"]) * F.col("c"))).alias("weight"))
    stages = [
        StringIndexer(inputCol=label, outputCol="label_index", stringOrderType="alphabetAsc"),
        VectorAssembler(inputCols=features, outputCol="features"),
        RandomForestClassifier(labelCol="label_index", featuresCol="features", weightCol="weight", numTrees=trees, seed=seed),
    ]
    model = Pipeline(stages=stages).fit(rows.join(weights, label))
    named = IndexToString(inputCol="prediction", outputCol="predicted", labels=model.stages[0].labels)
    return PipelineModel(stages=[*model.stages[1:], named])


def predict(model: PipelineModel, rows: DataFrame, key: str) -> DataFrame:
    """key, predicted, probability of it, probabilities by class."""
    labels = model.stages[-1].getLabels()
    scored = model.transform(rows)
    chances = F.map_from_arrays(F.array(*[F.lit(x) for x in labels]), vector_to_array("probability"))
    return scored.select(key, "predicted", F.element_at(chances, F.col("predicted")).alias("probability"), chances.alias("probabilities"))


def importances(model: PipelineModel, features: list[str] = FEATURE_COLUMNS) -> dict[str, float]:
    return dict(zip(features, (float(x) for x in model.stages[1].featureImportances.toArray()), strict=True))


def feature_means(rows: DataFrame, features: list[str] = FEATURE_COLUMNS) -> DataFrame:
    """One row with the mean of each feature."""
    return rows.agg(*[F.avg(c).alias(c) for c in features])


def top_causes(rows: DataFrame, key: str, weights: dict[str, float], means: dict[str, float], most: int = 5) -> DataFrame:
    """key, cause_no, feature, value, contribution: the features of greatest importance * (1 + distance from the mean), ties by the features' order.

    Both tables are as short as the feature vector. Sorting happens in each row.
    """
    parts = F.array(*[F.struct((-(F.lit(w) * (1 + F.abs(F.col(c) - F.lit(means.get(c, 0.0)))))).alias("minus"), F.lit(k).alias("k"), F.lit(c).alias("feature"), F.col(c).alias("value")) for k, (c, w) in enumerate(weights.items())])
    rows = rows.select(key, F.posexplode(F.slice(F.array_sort(parts), 1, most)).alias("cause_no", "x"))
    return rows.select(key, (F.col("cause_no") + 1).alias("cause_no"), "x.feature", "x.value", (-F.col("x.minus")).alias("contribution"))


def training_rows(files: DataFrame, synthetic: DataFrame) -> DataFrame:
    """Real and synthetic feature rows together, labelled by the risk score."""
    return with_risk(files.select(*FEATURE_COLUMNS).unionByName(synthetic.select(*FEATURE_COLUMNS)))


def save_model(model: PipelineModel, means: DataFrame, path: str) -> None:
    """The pipeline and the means that its causes are measured from."""
    model.write().overwrite().save(f"{path}/pipeline")
    means.write.mode("overwrite").parquet(f"{path}/means")


def load_model(spark: SparkSession, path: str) -> tuple[PipelineModel, dict[str, float]]:
    return PipelineModel.load(f"{path}/pipeline"), spark.read.parquet(f"{path}/means").first().asDict()
