"""Online validation against an answer key: confusion, accuracy, F1, trends, blind mode."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from axlewatch.operators.segments import running_sums
from axlewatch.schemas import METRIC_EVERY
from axlewatch.session import checkpointed


def _zero_safe(a: Column, b: Column) -> Column:
    return F.when(b == 0, 0.0).otherwise(a / b)


def score_against_key(predictions: DataFrame, key: DataFrame) -> DataFrame:
    """Left join on sample_id after predicting; rows without an answer stay unevaluated."""
    joined = predictions.join(
        key.select("sample_id", F.col("fault_type").alias("actual"),
                   F.col("fault_severity").alias("actual_severity")), "sample_id", "left")
    return (
        joined.withColumn("evaluated", F.col("actual").isNotNull())
        .withColumn("correct", F.col("actual") == F.col("pred"))
        .withColumn("severity_correct", F.col("actual").isNotNull()
                    & F.col("actual_severity").eqNullSafe(F.col("severity")))
    )


def predictions_to_rows(rows: DataFrame, predictions: DataFrame) -> DataFrame:
    """Keeps every row; those without a prediction (window not full) are not ready."""
    joined = rows.join(predictions, "sample_id", "left")
    return joined.withColumn("ready", F.col("pred").isNotNull())


UNKNOWN = "unknown"     # the row and column of classes that are not listed


def listed(column: str, classes: list[str]) -> Column:
    return F.when(F.col(column).isin(classes), F.col(column)).otherwise(UNKNOWN)


def confusion_cells(scored: DataFrame, classes: list[str] | None = None) -> DataFrame:
    """Evaluated rows per actual and predicted class; with `classes`, all others count as unknown."""
    rows = scored.where("evaluated")
    if classes:
        rows = rows.withColumns({
            "hit": F.coalesce(F.col("actual") == F.col("pred"), F.lit(False)),
            "actual": listed("actual", classes), "pred": listed("pred", classes)})
        # two different unlisted classes do not hit each other
        return rows.groupBy("actual", "pred").agg(F.count("*").alias("n"), F.count_if("hit").alias("hits"))
    return rows.groupBy("actual", "pred").agg(F.count("*").alias("n"))


def confusion_matrix(scored: DataFrame, classes: list[str]) -> DataFrame:
    """Rows actual, columns predicted, zero-filled over `classes` and unknown; the cells sum to `evaluated`."""
    spark, names = scored.sparkSession, [*classes, UNKNOWN]
    rows = spark.createDataFrame([(c,) for c in names], "actual string")
    wide = (
        confusion_cells(scored, classes).groupBy("actual").pivot("pred", names).agg(F.sum("n")))
    return rows.join(wide, "actual", "left").na.fill(0, subset=names)


def class_counts(scored: DataFrame, classes: list[str]) -> DataFrame:
    """Per class true positives, actual rows and predicted rows, from one pass."""
    side = F.explode(F.array(
        F.struct(F.col("actual").alias("class"), F.col("n").alias("support"), F.lit(0).alias("called"),
                 F.col("hits").alias("tp")),
        F.struct(F.col("pred").alias("class"), F.lit(0).cast("long").alias("support"),
                 F.col("n").alias("called"), F.lit(0).cast("long").alias("tp")))).alias("s")
    found = confusion_cells(scored, classes).select(side).groupBy("s.class").agg(
        *[F.sum(f"s.{c}").alias(c) for c in ("tp", "support", "called")])
    names = scored.sparkSession.createDataFrame([(c,) for c in [*classes, UNKNOWN]], "class string")
    return names.join(found, "class", "left").na.fill(0)


def _rates(counts: DataFrame) -> DataFrame:
    return (
        counts.withColumn("precision", _zero_safe(F.col("tp"), F.col("called")))
        .withColumn("recall", _zero_safe(F.col("tp"), F.col("support")))
        .withColumn("f1", _zero_safe(
            2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    )


def class_metrics(scored: DataFrame, classes: list[str], digits: int = 4) -> DataFrame:
    rates = _rates(class_counts(scored, classes))
    return rates.select(
        "class", *[F.round(c, digits).alias(c) for c in ("precision", "recall", "f1")], "support")


def macro_f1_live(scored: DataFrame, classes: list[str], digits: int = 4) -> DataFrame:
    """Mean F1 over the classes that occur."""
    rates = _rates(class_counts(scored, classes))
    return rates.agg(F.round(F.coalesce(
        F.avg(F.when(F.col("support") > 0, F.col("f1"))), F.lit(0.0)), digits).alias("macro_f1"))


def classification_report(scored: DataFrame, classes: list[str], digits: int = 4) -> DataFrame:
    """Per class, then accuracy, macro and support-weighted averages.

    Averages run over labels present among actual or predicted ones.
    """
    rates = _rates(class_counts(scored, classes)).where("support > 0 or called > 0")
    names = ("precision", "recall", "f1")
    per_class = rates.select("class", *names, "support")
    total = F.sum("support")
    averages = rates.agg(
        F.array(
            F.struct(F.lit("accuracy").alias("class"),
                     *[(F.sum("tp") / total).alias(c) for c in names], total.alias("support")),
            F.struct(F.lit("macro avg").alias("class"), *[F.avg(c).alias(c) for c in names],
                     total.alias("support")),
            F.struct(F.lit("weighted avg").alias("class"),
                     *[(F.sum(F.col(c) * F.col("support")) / total).alias(c) for c in names],
                     total.alias("support")),
        ).alias("a")).select(F.explode("a").alias("r")).select("r.*")
    both = per_class.unionByName(averages)
    return both.select("class", *[F.round(c, digits).alias(c) for c in names], "support")


def accuracy(scored: DataFrame, digits: int = 4) -> DataFrame:
    """Shares of correct classes and severities among evaluated rows; NULL without any."""
    n, hits = F.count_if("evaluated"), F.count_if("correct")
    sev = F.count_if("severity_correct")
    share = lambda c: F.when(n > 0, F.round(c / n, digits))
    return scored.agg(n.alias("evaluated"), hits.alias("correct"),
                      share(hits).alias("accuracy"), share(sev).alias("severity_accuracy"))


def tick_class_counts(predictions: DataFrame, classes: list[str]) -> DataFrame:
    """Raw predictions per tick and class, zero-filled."""
    return predictions.groupBy("tick").agg(*[
        F.count_if(F.col("pred") == c).alias(c) for c in classes])


def dominant_fault(counts: DataFrame, classes: list[str], normal: str = "normal") -> DataFrame:
    """Most frequent fault class per tick (first class on ties), NULL when there is none."""
    faults = [c for c in classes if c != normal]
    top = F.greatest(*[F.col(c) for c in faults]) if len(faults) > 1 else F.col(faults[0])
    name = F
    for c in faults:
        name = name.when((F.col(c) == top) & (top > 0), c)
    return counts.select("tick", name.alias("dominant"), top.alias("count"))


def uncertain_counts(predictions: DataFrame) -> DataFrame:
    """Uncertain predictions per tick and so far."""
    per_tick = predictions.groupBy("tick").agg(F.count_if("uncertain").alias("uncertain_now"))
    return running_sums(per_tick, [], "tick", {"uncertain_total": "uncertain_now"})


def unknown_anomaly_axles(predictions: DataFrame) -> DataFrame:
    """Axles per tick that the classifier calls normal and the anomaly layer does not know."""
    return predictions.where("unknown_anomaly").select("tick", "axle_key", "anomaly_score")


def accuracy_trend(scored: DataFrame, keep: int = 120) -> DataFrame:
    """Cumulative accuracy after each tick; the last `keep` ticks."""
    per_tick = scored.groupBy("tick").agg(
        F.count_if("evaluated").alias("evaluated"), F.count_if("correct").alias("correct"),
        F.count_if("severity_correct").alias("severity_correct"))
    sums = running_sums(per_tick, [], "tick", {
        "total": "evaluated", "hits": "correct", "severity_hits": "severity_correct"})
    trend = sums.select(
        "tick", "total", "hits", F.when(F.col("total") > 0, F.col("hits") / F.col("total")).alias("acc"),
        F.when(F.col("total") > 0, F.col("severity_hits") / F.col("total")).alias("severity_acc"))
    return trend.orderBy(F.desc("tick")).limit(keep)


def running_confusion(scored: DataFrame, classes: list[str]) -> DataFrame:
    """Cumulative counts after each tick: hits, severity hits and one column per confusion cell."""
    names = [*classes, UNKNOWN]
    cells = [(a, p) for a in names for p in names]
    hit = lambda a, p: (
        F.col("evaluated") & (listed("actual", classes) == a) & (listed("pred", classes) == p))
    per_tick = scored.groupBy("tick").agg(
        F.count_if("evaluated").alias("_n"), F.count_if("correct").alias("_hits"),
        F.count_if("severity_correct").alias("_severity"),
        *[F.count_if(hit(a, p)).alias(f"_n_{a}_{p}") for a, p in cells])
    return running_sums(per_tick, [], "tick", {
        "evaluated": "_n", "hits": "_hits", "severity_hits": "_severity",
        **{f"{a}__{p}": f"_n_{a}_{p}" for a, p in cells}}).select(
        "tick", "evaluated", "hits", "severity_hits", *[f"{a}__{p}" for a, p in cells])


def running_metrics(scored: DataFrame, classes: list[str], digits: int = 4) -> DataFrame:
    """Cumulative accuracy, severity accuracy and live macro F1 after each tick (NULL before any)."""
    cm = running_confusion(scored, classes)
    cell = lambda a, p: F.col(f"{a}__{p}")
    add = lambda cs: sum(cs[1:], cs[0])
    f1s, present = [], []
    names = [*classes, UNKNOWN]
    # hits of unlisted classes are those of no listed one
    hits = {c: cell(c, c) for c in classes}
    hits[UNKNOWN] = F.col("hits") - add(list(hits.values()))
    for c in names:
        support = add([cell(c, p) for p in names])
        called = add([cell(a, c) for a in names])
        precision, recall = _zero_safe(hits[c], called), _zero_safe(hits[c], support)
        f1 = _zero_safe(2 * precision * recall, precision + recall)
        f1s.append(F.when(support > 0, f1).otherwise(0.0))
        present.append(F.when(support > 0, 1).otherwise(0))
    n = F.col("evaluated")
    shown = lambda c: F.when(n > 0, F.round(c, digits))
    return cm.select(
        "tick", "evaluated", shown(F.col("hits") / n).alias("accuracy"),
        shown(F.col("severity_hits") / n).alias("severity_accuracy"),
        shown(_zero_safe(add(f1s), add(present))).alias("macro_f1"))


def metric_snapshots(metrics: DataFrame, every: int = METRIC_EVERY) -> DataFrame:
    """The ticks at which metrics are stored."""
    return metrics.where(F.col("tick") % every == 0)


def metric_rows(metrics: DataFrame, active: DataFrame) -> DataFrame:
    """Snapshots in the stored shape: metrics with the active alarms of their tick."""
    return metrics.join(active, "tick", "left").withColumn(
        "active_alarms", F.coalesce("active_alarms", F.lit(0)))


def blind_metrics(metrics: DataFrame, blind: bool) -> DataFrame:
    """In blind mode only the count is shown, until the last tick opens the aggregates.

    `metrics` has one row per tick; it is stored, so that finding the last tick does not compute
    it again.
    """
    metrics = checkpointed(metrics)
    last = metrics.agg(F.max("tick")).scalar()
    is_last = F.col("tick") >= last
    shown = is_last | F.lit(not blind)
    hidden = [F.when(shown, F.col(c)).alias(c) for c in ("accuracy", "severity_accuracy", "macro_f1")]
    return metrics.select(
        "tick", "evaluated", *hidden, (~shown).alias("blind"),
        (is_last & F.lit(blind)).alias("opened_at_end"))


def blind_rows(scored: DataFrame, blind: bool) -> DataFrame:
    """Blind mode never shows answers per row."""
    return scored.drop("actual", "actual_severity", "correct", "severity_correct") if blind else scored
