"""Validation queries against the answer key."""

from __future__ import annotations

from pyspark.sql import functions as F

from axlewatch.operators import scoring as S
from axlewatch.plans import adapt
from axlewatch.plans.registry import query

C = adapt.CLASSES
ALL = [*C, S.UNKNOWN]


def odd_key(spark, d):
    """The answer key with some answers of a class that no model lists."""
    odd = F.when(F.col("sample_id") % 60 == 11, "door_open").otherwise(F.col("fault_type"))
    return adapt.answer_key(spark, d).withColumn("fault_type", odd)


def odd_predictions(predictions):
    odd = F.when(F.col("sample_id") % 50 == 7, "door_fault").otherwise(F.col("pred"))
    return predictions.drop("fault_type", "fault_severity").withColumn("pred", odd)


def scored(spark, d):
    return S.score_against_key(odd_predictions(adapt.predictions(spark, d)), odd_key(spark, d))


def scored_ticks(spark, d):
    return S.score_against_key(odd_predictions(adapt.ticked_predictions(spark, d)), odd_key(spark, d))


# per class: tp, support, called and the three rates, in SQL
CLASS_SQL = """
WITH cls AS (SELECT unnest(['bearing_fault','normal','rail_crack','unknown']) AS class),
cnt AS (SELECT class, (SELECT count(*) FILTER (WHERE actual=class AND pred=class AND correct) FROM scored) AS tp,
  (SELECT count(*) FILTER (WHERE actual=class) FROM scored) AS support,
  (SELECT count(*) FILTER (WHERE pred=class) FROM scored) AS called FROM cls),
pr AS (SELECT *, CASE WHEN called=0 THEN 0.0 ELSE tp/CAST(called AS DOUBLE) END AS pre,
  CASE WHEN support=0 THEN 0.0 ELSE tp/CAST(support AS DOUBLE) END AS rec FROM cnt),
m AS (SELECT *, CASE WHEN pre+rec=0 THEN 0.0 ELSE 2*pre*rec/(pre+rec) END AS f FROM pr)
"""


@query("score_against_key", sql="""
SELECT d.doc_id AS sample_id, CASE WHEN n_chars > 600 THEN 1 ELSE 0 END AS pred, l.quality AS actual,
  l.doc_id IS NOT NULL AS evaluated, l.quality = CASE WHEN n_chars > 600 THEN 1 ELSE 0 END AS correct
FROM documents d LEFT JOIN labels l ON d.doc_id=l.doc_id""")
def score_against_key(spark, d):
    """Documents scored by their length against the labels, which cover only some of them."""
    docs = adapt.table(spark, d, "documents").select(
        F.col("doc_id").alias("sample_id"), F.when(F.col("n_chars") > 600, 1).otherwise(0).alias("pred"),
        F.lit(0).alias("severity"))
    key = adapt.table(spark, d, "labels").select(
        F.col("doc_id").alias("sample_id"), F.col("quality").alias("fault_type"),
        F.col("toxic").alias("fault_severity"))
    return S.score_against_key(docs, key).select("sample_id", "pred", "actual", "evaluated", "correct")


@query("predictions_to_rows", sql="""
SELECT d.doc_id AS sample_id, d.lang, l.quality AS pred, l.quality IS NOT NULL AS ready
FROM documents d LEFT JOIN labels l ON d.doc_id=l.doc_id""")
def predictions_to_rows(spark, d):
    docs = adapt.table(spark, d, "documents").select(F.col("doc_id").alias("sample_id"), "lang")
    given = adapt.table(spark, d, "labels").select(
        F.col("doc_id").alias("sample_id"), F.col("quality").alias("pred"))
    return S.predictions_to_rows(docs, given).select("sample_id", "lang", "pred", "ready")


@query("confusion_matrix", needs="scored", sql="""
SELECT c.actual, count(*) FILTER (WHERE s.pred='bearing_fault') AS bearing_fault,
  count(*) FILTER (WHERE s.pred='normal') AS "normal", count(*) FILTER (WHERE s.pred='rail_crack') AS rail_crack,
  count(*) FILTER (WHERE s.pred='unknown') AS unknown
FROM (SELECT unnest(['bearing_fault','normal','rail_crack','unknown']) AS actual) c LEFT JOIN scored s ON s.actual=c.actual
GROUP BY c.actual""")
def confusion_matrix(spark, d):
    return S.confusion_matrix(scored(spark, d), C)


@query("class_metrics", needs="scored", sql=CLASS_SQL + """
SELECT class, round(pre,6) AS precision, round(rec,6) AS recall, round(f,6) AS f1, support FROM m""")
def class_metrics(spark, d):
    return S.class_metrics(scored(spark, d), C, digits=6)


@query("macro_f1_live", needs="scored", sql=CLASS_SQL + """
SELECT round(coalesce(avg(f) FILTER (WHERE support > 0), 0), 6) AS macro_f1 FROM m""")
def macro_f1_live(spark, d):
    return S.macro_f1_live(scored(spark, d), C, digits=6)


@query("classification_report", needs="scored", sql=CLASS_SQL + """
, present AS (SELECT * FROM m WHERE support > 0 OR called > 0)
SELECT class, round(pre,6) AS precision, round(rec,6) AS recall, round(f,6) AS f1, support FROM present
UNION ALL SELECT 'accuracy', round(sum(tp)/CAST(sum(support) AS DOUBLE),6), round(sum(tp)/CAST(sum(support) AS DOUBLE),6),
  round(sum(tp)/CAST(sum(support) AS DOUBLE),6), CAST(sum(support) AS BIGINT) FROM present
UNION ALL SELECT 'macro avg', round(avg(pre),6), round(avg(rec),6), round(avg(f),6), CAST(sum(support) AS BIGINT) FROM present
UNION ALL SELECT 'weighted avg', round(sum(pre*support)/sum(support),6), round(sum(rec*support)/sum(support),6),
  round(sum(f*support)/sum(support),6), CAST(sum(support) AS BIGINT) FROM present""")
def classification_report(spark, d):
    return S.classification_report(scored(spark, d), C, digits=6)


@query("severity_report", needs="scored", sql="""
WITH cls AS (SELECT unnest(['none','mild','moderate','severe','unknown']) AS class),
cnt AS (SELECT class, (SELECT count(*) FILTER (WHERE actual_severity=class AND severity=class) FROM scored) AS tp,
  (SELECT count(*) FILTER (WHERE actual_severity=class) FROM scored) AS support,
  (SELECT count(*) FILTER (WHERE severity=class) FROM scored) AS called FROM cls),
pr AS (SELECT *, CASE WHEN called=0 THEN 0.0 ELSE tp/CAST(called AS DOUBLE) END AS pre,
  CASE WHEN support=0 THEN 0.0 ELSE tp/CAST(support AS DOUBLE) END AS rec FROM cnt)
SELECT class, round(pre,6) AS precision, round(rec,6) AS recall,
  round(CASE WHEN pre+rec=0 THEN 0.0 ELSE 2*pre*rec/(pre+rec) END,6) AS f1, support FROM pr""")
def severity_report(spark, d):
    from axlewatch.schemas import SEVERITIES
    both = scored(spark, d).select("evaluated", F.col("actual_severity").alias("actual"),
                                   F.col("severity").alias("pred"))
    return S.class_metrics(both, SEVERITIES, digits=6)


@query("accuracy", needs="scored", sql="""
SELECT count(*) AS evaluated, count(*) FILTER (WHERE correct) AS correct,
  round(count(*) FILTER (WHERE correct)/CAST(count(*) AS DOUBLE), 6) AS accuracy,
  round(count(*) FILTER (WHERE severity_correct)/CAST(count(*) AS DOUBLE), 6) AS severity_accuracy FROM scored""")
def accuracy(spark, d):
    return S.accuracy(scored(spark, d), digits=6)


TICK_COUNTS = """SELECT tick, count(*) FILTER (WHERE pred='bearing_fault') AS bearing_fault,
  count(*) FILTER (WHERE pred='normal') AS "normal", count(*) FILTER (WHERE pred='rail_crack') AS rail_crack
FROM pred GROUP BY tick"""


@query("tick_class_counts", needs="pred", sql=TICK_COUNTS)
def tick_class_counts(spark, d):
    return S.tick_class_counts(adapt.ticked_predictions(spark, d), C)


@query("dominant_fault", needs="pred", sql=f"""
WITH c AS ({TICK_COUNTS})
SELECT tick, CASE WHEN bearing_fault >= rail_crack AND bearing_fault > 0 THEN 'bearing_fault'
  WHEN rail_crack > 0 THEN 'rail_crack' END AS dominant, greatest(bearing_fault, rail_crack) AS "count" FROM c""")
def dominant_fault(spark, d):
    return S.dominant_fault(S.tick_class_counts(adapt.ticked_predictions(spark, d), C), C)


@query("uncertain_counts", needs="pred", sql="""
SELECT tick, uncertain_now, CAST(sum(uncertain_now) OVER (ORDER BY tick) AS BIGINT) AS uncertain_total FROM (
  SELECT tick, count(*) FILTER (WHERE uncertain) AS uncertain_now FROM pred GROUP BY tick)""")
def uncertain_counts(spark, d):
    return S.uncertain_counts(adapt.ticked_predictions(spark, d))


@query("unknown_anomaly_axles", needs="pred",
       sql="SELECT tick, axle_key, anomaly_score FROM pred WHERE unknown_anomaly")
def unknown_anomaly_axles(spark, d):
    return S.unknown_anomaly_axles(adapt.ticked_predictions(spark, d))


TREND = """SELECT tick, CAST(sum(n) OVER o AS BIGINT) AS total, CAST(sum(h) OVER o AS BIGINT) AS hits,
  CAST(sum(s) OVER o AS BIGINT) AS severity_hits FROM (
  SELECT tick, count(*) AS n, count(*) FILTER (WHERE correct) AS h, count(*) FILTER (WHERE severity_correct) AS s
  FROM scored GROUP BY tick) WINDOW o AS (ORDER BY tick)"""


@query("accuracy_trend", needs="scored", sql=f"""
SELECT tick, total, hits, hits/CAST(total AS DOUBLE) AS acc, severity_hits/CAST(total AS DOUBLE) AS severity_acc
FROM ({TREND}) ORDER BY tick DESC LIMIT 120""")
def accuracy_trend(spark, d):
    return S.accuracy_trend(scored_ticks(spark, d))


def _cells() -> str:
    return ", ".join(
        f"CAST(sum(count(*) FILTER (WHERE actual='{a}' AND pred='{p}')) OVER (ORDER BY tick) AS BIGINT) AS {a}__{p}"
        for a in ALL for p in ALL)


def _metrics_sql() -> str:
    rates = []
    for c in ALL:
        right = f"(hits-{'-'.join(f'{x}__{x}' for x in C)})" if c == "unknown" else f"{c}__{c}"
        called = "+".join(f"{a}__{c}" for a in ALL)
        support = "+".join(f"{c}__{p}" for p in ALL)
        rates.append(
            f"({called}) AS called_{c}, ({support}) AS support_{c}, "
            f"CASE WHEN ({called})=0 THEN 0.0 ELSE {right}/CAST(({called}) AS DOUBLE) END AS p_{c}, "
            f"CASE WHEN ({support})=0 THEN 0.0 ELSE {right}/CAST(({support}) AS DOUBLE) END AS r_{c}")
    f1 = "+".join(
        f"CASE WHEN support_{c}>0 AND p_{c}+r_{c}>0 THEN 2*p_{c}*r_{c}/(p_{c}+r_{c}) ELSE 0.0 END" for c in ALL)
    present = "+".join(f"CASE WHEN support_{c}>0 THEN 1 ELSE 0 END" for c in ALL)
    return f"""
WITH rc AS (SELECT tick, CAST(sum(count(*) FILTER (WHERE correct)) OVER (ORDER BY tick) AS BIGINT) AS hits,
  {_cells()} FROM scored GROUP BY tick),
rt AS (SELECT tick, {", ".join(rates)} FROM rc),
mt AS (SELECT tick, round(({f1})/CAST(({present}) AS DOUBLE), 6) AS macro_f1 FROM rt),
tr AS ({TREND}),
metrics AS (SELECT tr.tick, total AS evaluated, round(hits/CAST(total AS DOUBLE), 6) AS accuracy,
  round(severity_hits/CAST(total AS DOUBLE), 6) AS severity_accuracy, macro_f1 FROM tr JOIN mt ON tr.tick=mt.tick)
"""


@query("running_confusion", needs="scored", sql=f"SELECT tick, {_cells()} FROM scored GROUP BY tick")
def running_confusion(spark, d):
    return S.running_confusion(scored_ticks(spark, d), C).drop("evaluated", "hits", "severity_hits")


@query("running_metrics", needs="scored", sql=_metrics_sql() + "SELECT * FROM metrics")
def running_metrics(spark, d):
    return S.running_metrics(scored_ticks(spark, d), C, digits=6)


@query("metric_snapshots", needs="scored", sql=_metrics_sql() + "SELECT * FROM metrics WHERE tick % 25 = 0")
def metric_snapshots(spark, d):
    return S.metric_snapshots(S.running_metrics(scored_ticks(spark, d), C, digits=6))


@query("blind_projection", needs="scored", sql=_metrics_sql() + """
SELECT tick, evaluated, CASE WHEN last THEN accuracy END AS accuracy,
  CASE WHEN last THEN severity_accuracy END AS severity_accuracy, CASE WHEN last THEN macro_f1 END AS macro_f1,
  NOT last AS blind, last AS opened_at_end FROM (SELECT *, tick = max(tick) OVER () AS last FROM metrics)""")
def blind_projection(spark, d):
    return S.blind_metrics(S.running_metrics(scored_ticks(spark, d), C, digits=6), blind=True)


@query("evaluate_saved_predictions", sql="""
SELECT quality AS actual, CASE WHEN n_chars > 600 THEN 1 ELSE 0 END AS pred, count(*) AS n
FROM documents d JOIN labels l ON d.doc_id=l.doc_id GROUP BY ALL""")
def evaluate_saved_predictions(spark, d):
    return S.confusion_cells(score_against_key(spark, d))
