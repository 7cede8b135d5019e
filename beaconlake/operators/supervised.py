"""The supervised baseline: labelled rows, imputation, split, random forest, metrics."""

import math

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from beaconlake.functions.frames import security_code
from beaconlake.operators.iforest import available_features
from beaconlake.operators.ranking import bucketed_row_number, selected, value_counts
from beaconlake.schema import SEED, SUPERVISED_FEATURES
from beaconlake.session import materialise, path_exists

MIN_ROWS = 20
TEST_SHARE = 0.2
TREES, DEPTH = 100, 10
ROWS_PER_TASK = 1_000_000
# Rate texts that mean "no rates".
NO_RATES = ["", "unknown", "none", "nan"]
LABELS = [0, 1]
# What the stored description says about the baseline's worth.
LIMITATIONS = [
    "Rows of one capture are in both parts, so the split says little about other captures.",
    "Attack rows are simulated.",
    "Kept for comparison; detection uses profiles, evidence and per-access-point models.",
]


def drop_header_rows(rows: DataFrame) -> DataFrame:
    """Remove repeated header lines; rows without a name stay."""
    return rows.filter(~F.col("ssid").eqNullSafe("ssid")) if "ssid" in rows.columns else rows


def labelled_union(benign: DataFrame, attack: DataFrame) -> DataFrame:
    """Benign rows labelled 0 and attack rows labelled 1, by column name."""
    return (
        drop_header_rows(benign)
        .withColumn("label", F.lit(0))
        .unionByName(drop_header_rows(attack).withColumn("label", F.lit(1)), allowMissingColumns=True)
    )


def label_distribution(rows: DataFrame) -> DataFrame:
    return rows.groupBy("label").agg(F.count("*").alias("rows"))


def rates_in_text(text: Column) -> Column:
    """How many comma-separated rates a text lists."""
    items = F.filter(F.split(text, ","), lambda x: F.trim(x) != "")
    blank = text.isNull() | F.lower(F.trim(text)).isin(NO_RATES)
    return F.when(blank, F.lit(0)).otherwise(F.size(items))


def training_columns(rows: DataFrame) -> tuple[DataFrame, list[str]]:
    """Encode security, count rates where only their text is known, and make features numeric."""
    if "security" in rows.columns:
        rows = rows.withColumn("security_encoded", security_code(F.col("security")))
    if "rate_count" not in rows.columns and "supported_rates" in rows.columns:
        rows = rows.withColumn("rate_count", rates_in_text(F.col("supported_rates")))
    features = available_features(SUPERVISED_FEATURES, rows)
    if "security" not in rows.columns and "security_encoded" in features:
        features.remove("security_encoded")
    return rows.withColumns({f: F.expr(f"try_cast({f} AS DOUBLE)") for f in features}), features


def feature_medians(rows: DataFrame, features: list[str]) -> DataFrame:
    """``field, median`` over the whole table, exact, one row per feature with any value."""
    counts = materialise(value_counts(rows, [], {f: f for f in features}), "value-counts")
    return selected(counts, ["field"], {"median": 0.5}).drop("rows")


def impute_medians(rows: DataFrame) -> tuple[DataFrame, list[str]]:
    """Fill missing features with their median, or 0 when a feature is all missing."""
    rows, features = training_columns(rows)
    return fill_medians(rows, features), features


def fill_medians(rows: DataFrame, features: list[str]) -> DataFrame:
    # One number per feature comes to the driver.
    medians = {r["field"]: r["median"] for r in feature_medians(rows, features).collect()}
    return rows.withColumns(
        {
            f: F.coalesce(F.nanvl(F.col(f), F.lit(None)), F.lit(float(medians.get(f, 0.0))))
            for f in features
        }
    )


def test_sizes(counts: dict[int, int], share: float = TEST_SHARE) -> dict[int, int]:
    """Test rows per label: proportional, whole numbers, largest remainders first."""
    total = sum(counts.values())
    train = total - math.ceil(share * total)
    exact = {label: n * train / total for label, n in counts.items()}
    sizes = {label: math.floor(value) for label, value in exact.items()}
    by_remainder = sorted(exact, key=lambda label: (sizes[label] - exact[label], label))
    for label in by_remainder[: train - sum(sizes.values())]:
        sizes[label] += 1
    return {label: counts[label] - sizes[label] for label in counts}


def stratified_split(rows: DataFrame, share: float = TEST_SHARE, seed: int = SEED) -> DataFrame:
    """Add ``is_test``: an exact, repeatable share of each label, chosen by hash order."""
    counts = {r["label"]: r["rows"] for r in label_distribution(rows).collect()}
    sizes = test_sizes(counts, share)
    quota = F.when(F.lit(False), F.lit(0))
    for label, size in sizes.items():
        quota = quota.when(F.col("label") == label, F.lit(size))
    hashed = rows.withColumn("_draw", F.xxhash64("sensor_id", "frame_id", F.lit(seed)))
    ranked = bucketed_row_number(
        hashed, ["label"], F.shiftright("_draw", 50), ["_draw", "sensor_id", "frame_id"], "_rank"
    )
    return ranked.withColumn("is_test", F.col("_rank") <= quota).drop("_draw", "_rank")


def check_trainable(rows: DataFrame) -> dict[int, int]:
    """Label counts, or an error when a class is missing or there are too few rows."""
    counts = {r["label"]: r["rows"] for r in label_distribution(rows).collect()}
    if sum(counts.values()) < MIN_ROWS:
        raise ValueError(f"at least {MIN_ROWS} observations are required")
    if len(counts) < 2:
        raise ValueError("both benign and attack labels are required")
    return counts


def train_random_forest(
    split: DataFrame, features: list[str], seed: int = SEED
) -> RandomForestClassificationModel:
    """100 trees of depth 10 with balanced class weights, fitted on the training part."""
    train = split.filter(~F.col("is_test"))
    counts = {r["label"]: r["rows"] for r in label_distribution(train).collect()}
    total = sum(counts.values())
    weight = F.when(F.lit(False), F.lit(1.0))
    for label, n in counts.items():
        weight = weight.when(F.col("label") == label, F.lit(total / (len(counts) * n)))
    assembled = VectorAssembler(inputCols=features, outputCol="features").transform(
        train.withColumn("weight", weight)
    )
    classifier = RandomForestClassifier(
        labelCol="label", featuresCol="features", weightCol="weight", numTrees=TREES,
        maxDepth=DEPTH, seed=seed,
    )
    return classifier.fit(assembled.select("features", "label", "weight"))


def predict(
    model: RandomForestClassificationModel, rows: DataFrame, features: list[str]
) -> DataFrame:
    assembled = VectorAssembler(inputCols=features, outputCol="features").transform(rows)
    return (
        model.transform(assembled)
        .withColumn("attack_probability", vector_to_array("probability")[1])
        .withColumn("prediction", F.col("prediction").cast("int"))
        .drop("features", "rawPrediction", "probability")
    )


def confusion_counts(predictions: DataFrame) -> DataFrame:
    """One row: the four cells and their total."""

    def cell(label: int, prediction: int) -> Column:
        return F.count(F.when((F.col("label") == label) & (F.col("prediction") == prediction), 1))

    return predictions.agg(
        cell(0, 0).alias("true_negatives"), cell(0, 1).alias("false_positives"),
        cell(1, 0).alias("false_negatives"), cell(1, 1).alias("true_positives"),
        F.count("*").alias("rows"),
    )


def _ratio(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def classification_report(predictions: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per class, their averages, and accuracy."""
    cells = confusion_counts(predictions)
    tn, fp, fn, tp = map(
        F.col, ["true_negatives", "false_positives", "false_negatives", "true_positives"]
    )

    def line(name: str, hit: Column, claimed: Column, actual: Column) -> Column:
        precision, recall = _ratio(hit, claimed), _ratio(hit, actual)
        return F.struct(
            F.lit(name).alias("class"), precision.alias("precision"), recall.alias("recall"),
            _ratio(2 * precision * recall, precision + recall).alias("f1"),
            actual.alias("support"),
        )

    benign = line("Benign", tn, tn + fn, tn + fp)
    attack = line("Simulated Attack", tp, tp + fp, tp + fn)
    lines = cells.select("rows", ((tn + tp) / F.col("rows")).alias("accuracy"),
                         benign.alias("b"), attack.alias("a"))

    def average(name: str, b: Column, a: Column) -> Column:
        return F.struct(
            F.lit(name).alias("class"),
            *[(F.col(f"b.{m}") * b + F.col(f"a.{m}") * a).alias(m) for m in ("precision", "recall", "f1")],
            (F.col("b.support") + F.col("a.support")).alias("support"),
        )

    half = F.lit(0.5)
    share_b, share_a = F.col("b.support") / F.col("rows"), F.col("a.support") / F.col("rows")
    rows = F.array(
        F.col("b"), F.col("a"), average("macro avg", half, half),
        average("weighted avg", share_b, share_a),
    )
    return lines.select("accuracy", F.inline(rows))


def feature_importance(
    spark: SparkSession, model: RandomForestClassificationModel, features: list[str]
) -> DataFrame:
    """Features by importance, highest first."""
    pairs = [(f, float(v)) for f, v in zip(features, model.featureImportances.toArray())]
    return spark.createDataFrame(pairs, "feature string, importance double").orderBy(
        F.desc("importance"), "feature"
    )


def train_baseline(rows: DataFrame, path: str | None = None, retrain: bool = False):
    """Train, evaluate and optionally save the baseline; reuse a saved one unless retraining.

    Returns the model, its features and the one-row metrics table.
    """
    spark = rows.sparkSession
    if path is not None and not retrain:
        saved = load_baseline(spark, path)
        if saved is not None:
            return saved
    # Features are computed once; counts, medians and the split then read the stored columns.
    columns, features = training_columns(rows)
    stored = materialise(columns.select("sensor_id", "frame_id", "label", *features), "labelled-features")
    labels = check_trainable(stored)
    filled = fill_medians(stored, features)
    split = materialise(
        stratified_split(filled).select("frame_id", "label", "is_test", *features), "labelled-split",
        # Every tree level is a pass over all rows: use every core, and a task for each million rows.
        parts=max(spark.sparkContext.defaultParallelism, -(-sum(labels.values()) // ROWS_PER_TASK)),
    )
    model = train_random_forest(split, features)
    test = predict(model, split.filter("is_test"), features)
    about = {
        "status": "legacy_supervised_baseline", "model_type": "RandomForestClassifier",
        "evaluation": "exploratory_random_row_split",
    }
    train_rows = split.filter(~F.col("is_test")).count()
    metrics = confusion_counts(test).select(
        *[F.lit(v).alias(k) for k, v in about.items()],
        F.lit(TREES).alias("n_estimators"), F.lit(DEPTH).alias("max_depth"),
        F.array(*map(F.lit, features)).alias("features"),
        F.array(*map(F.lit, LIMITATIONS)).alias("limitations"),
        ((F.col("true_negatives") + F.col("true_positives")) / F.col("rows")).alias("accuracy"),
        "true_negatives", "false_positives", "false_negatives", "true_positives",
        F.lit(train_rows).alias("train_rows"), F.col("rows").alias("test_rows"),
    )
    if path is not None:
        model.write().overwrite().save(f"{path}/model")
        metrics.write.mode("overwrite").parquet(f"{path}/metadata")
        metrics = spark.read.parquet(f"{path}/metadata")
    return model, features, metrics


def load_baseline(spark: SparkSession, path: str):
    """The saved model, its features and metrics, or None when nothing is saved there."""
    if not path_exists(spark, f"{path}/metadata/_SUCCESS"):
        return None
    metrics = spark.read.parquet(f"{path}/metadata")
    model = RandomForestClassificationModel.load(f"{path}/model")
    return model, list(metrics.first()["features"]), metrics
