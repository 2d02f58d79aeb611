"""Scaling, class weights, fault and severity models, and the anomaly layer, on Spark ML.

The classifiers are multinomial regressions on the flattened window; the anomaly layer is a linear
autoencoder (principal components) fitted on normal windows only.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import PCA, PCAModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from axlewatch.functions import exprs as X
from axlewatch.operators.segments import Timeline, exact_percentile, global_rank
from axlewatch.operators.windows import fit_val_split, sliding_sequences
from axlewatch.schemas import FEATURES, SEVERITIES, WINDOW_ROWS, WINDOW_STRIDE
from axlewatch.session import checkpointed, stored

SMOOTHING = 0.5          # fixed value: exponent that softens inverse-frequency weights
BOTTLENECK = 16          # fixed value: width of the anomaly bottleneck
THRESHOLD_SHARE = 0.99   # fixed value: percentile of normal errors that sets the threshold
HOLDOUT_PERCENT = 15


@dataclass(frozen=True)
class Scaler:
    """Mean and population deviation per feature (a deviation of 0 counts as 1)."""

    features: list[str]
    mean: list[float]
    scale: list[float]

    def item(self) -> Column:
        return F.array(*[(F.col(c) - m) / s for c, m, s in zip(self.features, self.mean, self.scale)])


def scaler_fit(df: DataFrame, features: list[str] = FEATURES) -> DataFrame:
    """One row per feature: mean and scale, from one pass."""
    rows = [F.struct(
        F.lit(c).alias("feature"), F.avg(c).alias("mean"),
        F.when(F.stddev_pop(c) == 0, 1.0).otherwise(F.stddev_pop(c)).alias("scale")) for c in features]
    return df.agg(F.array(*rows).alias("r")).select(F.explode("r").alias("r")).select("r.*")


def fit_scaler(df: DataFrame, features: list[str] = FEATURES) -> Scaler:
    """The fitted parameters (two numbers per feature) as a value."""
    got = {r["feature"]: r for r in scaler_fit(df, features).collect()}
    return Scaler(list(features), [got[c]["mean"] for c in features], [got[c]["scale"] for c in features])


def scale_features(df: DataFrame, scaler: Scaler) -> DataFrame:
    return df.withColumn("scaled", scaler.item())


def label_codes(df: DataFrame, label: str) -> DataFrame:
    """Dense code of each label in alphabetical order; NULL is no label."""
    names = df.select(label).where(F.col(label).isNotNull()).distinct()
    return global_rank(names, [label], "code").select(F.col("code").cast("int").alias("code"), label)


def class_weights(df: DataFrame, label: str, classes: list | None = None,
                  power: float = SMOOTHING, counted: str | None = None) -> DataFrame:
    """Softened inverse-frequency weights with mean 1; absent classes start from 1.

    `counted` names the column of counts when `df` is aggregated already.
    """
    rows = F.sum(counted) if counted else F.count("*")
    counts = checkpointed(df.groupBy(label).agg(rows.alias("n")))   # one row per class
    total = counts.agg(F.sum("n").alias("rows"), F.count("*").alias("present"))
    raw = F.col("rows") / (F.col("present") * F.col("n"))
    if classes is not None:
        kind = counts.schema[label].dataType.simpleString()
        listed = df.sparkSession.createDataFrame([(c,) for c in classes], f"{label} {kind}")
        counts = listed.join(counts, label, "left")
    sized = counts.withColumn("rows", total.select("rows").scalar()).withColumn(
        "present", total.select("present").scalar())
    soft = sized.withColumn("_w", F.pow(F.coalesce(raw, F.lit(1.0)), power))
    mean = soft.agg(F.avg("_w")).scalar()
    return soft.select(label, F.coalesce("n", F.lit(0)).alias("n"), (F.col("_w") / mean).alias("weight"))


# ---------------------------------------------------------------- windows as vectors

def window_vectors(line: Timeline, scaler: Scaler, size: int = WINDOW_ROWS,
                   stride: int = WINDOW_STRIDE, split: bool = False) -> DataFrame:
    """Scaled windows flattened to one vector; labels and severity code of the last row."""
    make = fit_val_split if split else sliding_sequences
    rows = make(line, scaler.item(), size, stride).rows
    flat = F.flatten("window")
    # Spark may test a score before it drops incomplete windows, so those get a full width too
    blank = F.array_repeat(F.lit(0.0), size * len(scaler.features))
    full = F.when(F.size("window") == size, flat).otherwise(blank)
    return rows.withColumn("features", array_to_vector(full)).withColumn(
        "severity_code", X.severity_code(F.col("fault_severity"))).drop("window")


def stored_windows(windows: DataFrame, *columns: str) -> DataFrame:
    """Vectors with labels and `columns`, stored: a fit reads its windows four times, and each time would build them again."""
    return stored(windows.select("sample_id", "fault_type", "severity_code", *columns, "features"), "windows")


def vectors_of(windows: DataFrame, model: FaultModel) -> DataFrame:
    """Vectors of windows that a stream has already collected (and scaled)."""
    full = F.size("window") == model.window
    blank = F.array_repeat(F.lit(0.0), model.window * len(model.scaler.features))
    return windows.withColumn("features", array_to_vector(
        F.when(full, F.flatten("window")).otherwise(blank))).drop("window")


def holdout_split(windows: DataFrame, percent: int = HOLDOUT_PERCENT) -> DataFrame:
    """Adds holdout. Whole axles go to one side, so overlapping windows never straddle."""
    share = F.conv(F.substring(F.md5("axle_key"), 1, 8), 16, 10).cast("long") % 100
    return windows.withColumn("holdout", share < percent)


# ---------------------------------------------------------------- classifiers

@dataclass(frozen=True)
class FaultModel:
    """Both classifiers with what is needed to rebuild their inputs."""

    scaler: Scaler
    classes: list[str]
    fault: PipelineModel
    severity: PipelineModel
    window: int = WINDOW_ROWS
    stride: int = WINDOW_STRIDE
    curve: list[float] | None = None    # objective of the class model after each iteration

    def save(self, spark: SparkSession, path: str) -> None:
        self.fault.write().overwrite().save(f"{path}/fault")
        self.severity.write().overwrite().save(f"{path}/severity")
        meta = {"scaler": asdict(self.scaler), "classes": self.classes,
                "window": self.window, "stride": self.stride, "curve": training_curve(self)}
        spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1).write.mode(
            "overwrite").parquet(f"{path}/meta")

    @staticmethod
    def load(spark: SparkSession, path: str) -> FaultModel:
        meta = json.loads(spark.read.parquet(f"{path}/meta").first()["meta"])
        return FaultModel(
            Scaler(**meta["scaler"]), meta["classes"], PipelineModel.load(f"{path}/fault"),
            PipelineModel.load(f"{path}/severity"), meta["window"], meta["stride"],
            meta["curve"])


def _fit(windows: DataFrame, counts: DataFrame, label: Column, codes: list, max_iter: int) -> PipelineModel:
    data, counts = (df.withColumn("_label", label.cast("double")) for df in (windows, counts))
    table = class_weights(counts, "_label", [float(c) for c in codes], counted="n")
    weights = {r["_label"]: r["weight"] for r in table.collect()}
    weight = F.lit(1.0)
    for code, value in weights.items():
        weight = F.when(F.col("_label") == code, value).otherwise(weight)
    model = LogisticRegression(
        featuresCol="features", labelCol="_label", weightCol="_weight", family="multinomial",
        maxIter=max_iter, regParam=0.001, predictionCol="_code", probabilityCol="_probs",
        rawPredictionCol="_raw")
    return Pipeline(stages=[model]).fit(data.withColumn("_weight", weight))


def fit_fault_model(windows: DataFrame, scaler: Scaler, max_iter: int = 50) -> FaultModel:
    """Weighted class and severity classifiers on the same window vectors.

    Labels and both weights come from one count by class and severity, for which no vector is built.
    """
    counts = checkpointed(windows.groupBy("fault_type", "severity_code").agg(F.count("*").alias("n")))
    classes = [r["fault_type"] for r in label_codes(counts, "fault_type").orderBy("code").collect()]
    names = F.array(*[F.lit(c) for c in classes])
    code = F.array_position(names, F.col("fault_type")) - 1
    fault = _fit(windows, counts, code, list(range(len(classes))), max_iter)
    severity = _fit(windows, counts, F.col("severity_code"), list(range(len(SEVERITIES))), max_iter)
    return FaultModel(scaler, classes, fault, severity)


def _named(df: DataFrame, names: list[str], label: str, conf: str, probs: str) -> DataFrame:
    """Class, confidence and probabilities; a class the model never saw has probability 0."""
    given = vector_to_array("_probs")
    out = df.withColumn(probs, F.transform(
        F.sequence(F.lit(1), F.lit(len(names))),
        lambda i: F.coalesce(F.get(given, i - 1), F.lit(0.0))))
    lookup = F.array(*[F.lit(n) for n in names])
    best = X.argmax(F.col(probs))
    return out.withColumn(label, F.get(lookup, best.cast("int"))).withColumn(
        conf, F.array_max(probs)).drop("_probs", "_raw", "_code")


def score_models(windows: DataFrame, model: FaultModel) -> DataFrame:
    """pred, conf, probs and severity, sev_conf, sev_probs of every window."""
    one = _named(model.fault.transform(windows), model.classes, "pred", "conf", "probs")
    two = _named(model.severity.transform(one), SEVERITIES, "severity", "sev_conf", "sev_probs")
    return (two.withColumn("entropy", X.normalized_entropy(F.col("probs"), len(model.classes)))
            .withColumn("uncertain", X.is_uncertain(F.col("entropy"))))


def training_curve(model: FaultModel) -> list[float]:
    """Objective after each iteration of the class model; a loaded model has it stored."""
    if model.curve is not None:
        return list(model.curve)
    return list(model.fault.stages[-1].summary.objectiveHistory)


# ---------------------------------------------------------------- anomaly layer

@dataclass(frozen=True)
class AnomalyModel:
    """Components and threshold, with what is needed to rebuild the inputs they were fitted on."""

    components: PCAModel
    threshold: float
    scaler: Scaler | None = None
    window: int = WINDOW_ROWS
    width: int = BOTTLENECK
    share: float = THRESHOLD_SHARE
    classes: list[str] | None = None    # those the windows had; the components know `normal` only

    def save(self, spark: SparkSession, path: str) -> None:
        self.components.write().overwrite().save(f"{path}/components")
        meta = {"threshold": self.threshold, "scaler": self.scaler and asdict(self.scaler), "window": self.window,
                "width": self.width, "share": self.share, "classes": self.classes}
        spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1).write.mode(
            "overwrite").parquet(f"{path}/meta")

    @staticmethod
    def load(spark: SparkSession, path: str) -> AnomalyModel:
        meta = json.loads(spark.read.parquet(f"{path}/meta").first()["meta"])
        scaler = Scaler(**meta.pop("scaler")) if meta["scaler"] else meta.pop("scaler")
        return AnomalyModel(PCAModel.load(f"{path}/components"), scaler=scaler, **meta)


def rescaled(vector: Column, given: Scaler, wanted: Scaler) -> Column:
    """A flattened window of one scaler as that of another with the same features."""
    if given.features != wanted.features:
        raise ValueError("scalers of different features")
    n = F.lit(len(given.features))
    consts = [F.array(*map(F.lit, v)) for v in (given.mean, given.scale, wanted.mean, wanted.scale)]
    at = lambda i: [F.get(c, i % n) for c in consts]

    def moved(x: Column, i: Column) -> Column:
        mean, scale, new_mean, new_scale = at(i)
        return (x * scale + mean - new_mean) / new_scale
    return array_to_vector(F.transform(vector_to_array(vector), moved))


def _with_error(windows: DataFrame, components: PCAModel) -> DataFrame:
    """Mean squared reconstruction error.

    The components are orthonormal, so |x - PP'x|² = |x|² - |P'x|²: no reconstruction is built.
    """
    squares = lambda c: F.aggregate(
        vector_to_array(c), F.lit(0.0), lambda acc, x: acc + x * x)
    coded = components.transform(windows)
    error = (squares("features") - squares("_coded")) / F.size(vector_to_array("features"))
    return coded.withColumn("anomaly_error", F.greatest(error, F.lit(0.0))).drop("_coded")


def fit_anomaly_model(windows: DataFrame, width: int = BOTTLENECK, share: float = THRESHOLD_SHARE,
                      scaler: Scaler | None = None, window: int = WINDOW_ROWS) -> AnomalyModel:
    """Components of the normal windows; threshold from the held-out normal axles.

    With so few axles that one side of the split is empty, both use all normal windows.
    """
    # one count without vectors: the classes, and the sides of the split that normal windows fall on
    found = holdout_split(windows).groupBy("fault_type", "holdout").agg(F.count("*").alias("n")).collect()
    classes = sorted({r["fault_type"] for r in found if r["fault_type"] is not None})
    sides = sum(r["fault_type"] == "normal" for r in found)
    normal = holdout_split(windows.where(F.col("fault_type") == "normal"))
    if sides < 2:
        normal = normal.withColumn("holdout", F.lit(True))
    fit = PCA(k=width, inputCol="features", outputCol="_coded").fit(normal.where("not holdout") if sides > 1 else normal)
    # two columns, stored, because the percentile reads them several times
    errors = checkpointed(_with_error(normal.where("holdout"), fit).select("anomaly_error", "sample_id"))
    threshold = exact_percentile(errors, "anomaly_error", share, ["sample_id"]).first()[0]
    return AnomalyModel(fit, threshold, scaler, window, width, share, classes)


def score_anomalies(windows: DataFrame, model: AnomalyModel | None, scaler: Scaler | None = None) -> DataFrame:
    """Anomaly columns; all NULL when there is no anomaly model.

    `scaler` is the one the windows were scaled with. Where the model was fitted with another, it sees its own.
    """
    if model is None:
        return windows.withColumns({
            "anomaly_error": F.lit(None).cast("double"), "anomaly": F.lit(None).cast("boolean"),
            "anomaly_score": F.lit(None).cast("double"), "unknown_anomaly": F.lit(None).cast("boolean")})
    limit, error = F.lit(model.threshold), F.col("anomaly_error")
    seen = windows
    if scaler is not None and model.scaler is not None and scaler != model.scaler:
        seen = windows.withColumn("features", rescaled(F.col("features"), scaler, model.scaler))
    return (
        _with_error(seen, model.components)
        .withColumn("anomaly", error > limit)
        .withColumn("anomaly_score", X.anomaly_score(error, limit))
        .withColumn("unknown_anomaly", X.unknown_anomaly(error, limit, F.col("pred")))
    )


def anomaly_rates(scored: DataFrame, label: str = "fault_type", normal: str = "normal",
                  digits: int = 4) -> DataFrame:
    """Windows and flagged share per class, with the false-alarm and mean catch rates."""
    per_class = checkpointed(scored.groupBy(F.col(label).alias("class")).agg(
        F.count("*").alias("windows"), F.round(F.avg(F.col("anomaly").cast("double")), digits).alias("rate")))
    false_alarm = per_class.agg(F.coalesce(
        F.max(F.when(F.col("class") == normal, F.col("rate"))), F.lit(0.0))).scalar()
    caught = per_class.agg(F.round(F.avg(F.when(F.col("class") != normal, F.col("rate"))), digits)).scalar()
    return per_class.withColumn("false_alarm_rate", false_alarm).withColumn("catch_rate", caught)
