"""Catalogue: classifier evaluation.  Truth = ``labels.quality``, prediction = ``labels.toxic``;
three-class logits = 10 × the first three embedding values, truth = embedding label mod 3."""

from __future__ import annotations

from pyspark.sql import functions as F

from postlens.operators import evaluate as E
from postlens.plans.registry import register
from postlens.sources.tables import table

CLASSES = (0, 1)
NAMES = ("Irrelevant", "Relevant")
SENT_CLASSES = (0, 1, 2)


def _preds(spark, sf_dir):
    lab = table(spark, sf_dir, "labels")
    return lab.select("doc_id", F.col("quality").alias("label"), F.col("toxic").alias("pred"))


def _clustered(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", F.substring("source", 4, 10).cast("int").alias("cluster"))
    return _preds(spark, sf_dir).join(docs, "doc_id")


_PC = """
cm AS (SELECT {by} label, pred, count(*) AS n FROM {src} GROUP BY ALL),
cls AS (SELECT unnest([{classes}]) AS class),
agg AS (SELECT {by} class,
               sum(CASE WHEN label = class AND pred = class THEN n ELSE 0 END) AS tp,
               sum(CASE WHEN label = class THEN n ELSE 0 END) AS support,
               sum(CASE WHEN pred = class THEN n ELSE 0 END) AS predicted
        FROM cm CROSS JOIN cls GROUP BY ALL),
pc AS (SELECT {by} class,
              CASE WHEN predicted > 0 THEN tp / predicted ELSE 0.0 END AS precision,
              CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS recall,
              CASE WHEN support + predicted > 0 THEN 2 * tp / (support + predicted) ELSE 0.0 END AS f1,
              CAST(support AS BIGINT) AS support, CAST(predicted AS BIGINT) AS predicted
       FROM agg)
"""


def _pc(src="p", by="", classes=CLASSES):
    return _PC.format(src=src, by=by, classes=", ".join(str(c) for c in classes))


_P = "p AS (SELECT doc_id, quality AS label, toxic AS pred FROM labels)"
_PCL = ("p AS (SELECT l.doc_id, l.quality AS label, l.toxic AS pred, "
        "CAST(substr(d.source, 4, 10) AS INTEGER) AS cluster FROM labels l JOIN documents d USING (doc_id))")


@register("class_counts", "SELECT quality AS label, count(*) AS count FROM labels GROUP BY 1")
def class_counts(spark, sf_dir):
    return E.class_counts(_preds(spark, sf_dir), "label")


@register("class_metrics", f"WITH {_P}, {_pc()} SELECT * FROM pc")
def class_metrics(spark, sf_dir):
    return E.per_class_metrics(_preds(spark, sf_dir), CLASSES)


_SUMMARY = """
acc AS (SELECT sum(CASE WHEN label = pred THEN n ELSE 0 END) / sum(n) AS accuracy,
               CAST(sum(n) AS BIGINT) AS support FROM cm),
mac AS (SELECT avg(precision) FILTER (WHERE support + predicted > 0) AS macro_precision,
               avg(recall) FILTER (WHERE support + predicted > 0) AS macro_recall,
               avg(f1) FILTER (WHERE support + predicted > 0) AS macro_f1 FROM pc)
"""


@register("metrics_summary", f"WITH {_P}, {_pc()}, {_SUMMARY} SELECT * FROM acc, mac")
def metrics_summary(spark, sf_dir):
    return E.summary_metrics(_preds(spark, sf_dir), CLASSES)


_WEIGHTED = """
wm AS (SELECT sum(precision * support) / sum(support) AS weighted_precision,
              sum(recall * support) / sum(support) AS weighted_recall,
              sum(f1 * support) / sum(support) AS weighted_f1,
              CAST(sum(support) AS BIGINT) AS total_support FROM pc)
"""


@register("weighted_metrics", f"WITH {_P}, {_pc()}, {_WEIGHTED} SELECT * FROM wm WHERE total_support > 0")
def weighted_metrics(spark, sf_dir):
    return E.weighted_metrics(E.per_class_metrics(_preds(spark, sf_dir), CLASSES))


@register("confusion", """
WITH cls AS (SELECT unnest([0, 1]) AS label)
SELECT cls.label, CAST(count(CASE WHEN l.toxic = 0 THEN 1 END) AS BIGINT) AS pred_0,
       CAST(count(CASE WHEN l.toxic = 1 THEN 1 END) AS BIGINT) AS pred_1
FROM cls LEFT JOIN labels l ON l.quality = cls.label GROUP BY cls.label
""")
def confusion(spark, sf_dir):
    return E.confusion_matrix(_preds(spark, sf_dir), CLASSES)


@register("classification_report", f"""
WITH {_P}, {_pc()}, {_SUMMARY}, {_WEIGHTED}
SELECT CASE class WHEN 0 THEN '{NAMES[0]}' ELSE '{NAMES[1]}' END AS row, precision, recall, f1, support FROM pc
UNION ALL SELECT 'accuracy', NULL, NULL, accuracy, support FROM acc
UNION ALL SELECT 'macro avg', macro_precision, macro_recall, macro_f1, support FROM acc, mac
UNION ALL SELECT 'weighted avg', weighted_precision, weighted_recall, weighted_f1, total_support FROM wm
  WHERE total_support > 0
""")
def classification_report(spark, sf_dir):
    return E.classification_report(_preds(spark, sf_dir), CLASSES, NAMES)


@register("cluster_metrics", f"WITH {_PCL}, {_pc(by='cluster,')} SELECT * FROM pc")
def cluster_metrics(spark, sf_dir):
    return E.per_class_metrics(_clustered(spark, sf_dir), CLASSES, by=["cluster"])


@register("cluster_summary", f"""
WITH {_PCL}, {_pc(by='cluster,')},
acc AS (SELECT cluster, sum(CASE WHEN label = pred THEN n ELSE 0 END) / sum(n) AS accuracy,
               CAST(sum(n) AS BIGINT) AS support FROM cm GROUP BY cluster),
mac AS (SELECT cluster, avg(precision) FILTER (WHERE support + predicted > 0) AS macro_precision,
               avg(recall) FILTER (WHERE support + predicted > 0) AS macro_recall,
               avg(f1) FILTER (WHERE support + predicted > 0) AS macro_f1 FROM pc GROUP BY cluster)
SELECT * FROM acc JOIN mac USING (cluster)
""")
def cluster_summary(spark, sf_dir):
    return E.summary_metrics(_clustered(spark, sf_dir), CLASSES, by=["cluster"])


@register("error_table", """
SELECT doc_id, quality AS label, toxic AS pred,
       CASE WHEN quality = 0 AND toxic = 1 THEN 'False Positive (FP)'
            WHEN quality = 1 AND toxic = 0 THEN 'False Negative (FN)' END AS error_type
FROM labels WHERE quality <> toxic
""")
def error_table(spark, sf_dir):
    return E.error_table(_preds(spark, sf_dir))


_SENT = ("s AS (SELECT CASE WHEN toxic = 1 THEN 0 WHEN quality = 1 THEN 2 ELSE 1 END AS label FROM labels), "
         "c AS (SELECT label, count(*) AS n FROM s GROUP BY label)")


def _sent_labels(spark, sf_dir):
    lab = table(spark, sf_dir, "labels")
    return lab.select(F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 1, 2).otherwise(1).alias("label"))


@register("class_weights_balanced", f"""
WITH {_SENT}, t AS (SELECT sum(n) AS total FROM c)
SELECT cls AS class, total / (3 * coalesce((SELECT n FROM c WHERE label = cls), 0)) AS weight
FROM t, (SELECT unnest([0, 1, 2]) AS cls)
""")
def class_weights_balanced(spark, sf_dir):
    return E.class_weights(_sent_labels(spark, sf_dir), "label", "balanced", SENT_CLASSES)


@register("class_weights_binary", """
WITH c AS (SELECT count(CASE WHEN quality = 0 THEN 1 END) AS n0, count(CASE WHEN quality = 1 THEN 1 END) AS n1
           FROM labels)
SELECT 0 AS class, n1 / (n0 + n1) AS weight FROM c UNION ALL SELECT 1, n0 / (n0 + n1) FROM c
""")
def class_weights_binary(spark, sf_dir):
    return E.class_weights(_preds(spark, sf_dir), "label", "binary")


def _logits(spark, sf_dir):
    emb = table(spark, sf_dir, "embeddings")
    logits = F.array(*[F.col("embedding")[i].cast("double") * 10.0 for i in range(3)])
    return emb.select("vec_id", logits.alias("logits"), (F.col("label") % 3).alias("label"))


_LOGITS = """
e AS (SELECT vec_id, [CAST(embedding[1] AS DOUBLE) * 10.0, CAST(embedding[2] AS DOUBLE) * 10.0,
                      CAST(embedding[3] AS DOUBLE) * 10.0] AS logits, label % 3 AS label FROM embeddings),
x AS (SELECT *, list_transform(logits, lambda v: exp(v - list_max(logits))) AS ex FROM e),
pr AS (SELECT vec_id, label, logits, list_transform(ex, lambda v: v / list_sum(ex)) AS probs FROM x)
"""


@register("softmax_argmax", f"""
WITH {_LOGITS}
SELECT vec_id, CAST(list_position(probs, list_max(probs)) - 1 AS INTEGER) AS pred,
       list_max(probs) AS confidence, probs[1] AS prob_0, probs[2] AS prob_1, probs[3] AS prob_2
FROM pr
""")
def softmax_argmax(spark, sf_dir):
    out = E.score_columns(_logits(spark, sf_dir), "logits", n_classes=3)
    return out.select("vec_id", "pred", "confidence", "prob_0", "prob_1", "prob_2")


# Fixed values of the catalogue: per-class weights and focusing parameter of the loss report.
LOSS_WEIGHTS = (1.0, 2.0, 0.5)
GAMMA = 2.0


@register("loss_report", f"""
WITH {_LOGITS},
ce AS (SELECT label, -ln(probs[label + 1]) AS ce,
              CASE label WHEN 0 THEN {LOSS_WEIGHTS[0]} WHEN 1 THEN {LOSS_WEIGHTS[1]} ELSE {LOSS_WEIGHTS[2]} END AS w
       FROM pr)
SELECT avg(ce) AS ce_mean, sum(w * ce) / sum(w) AS weighted_ce,
       avg(pow(1.0 - exp(-ce), {GAMMA}) * ce * w) AS focal_mean, sum(pow(1.0 - exp(-ce), {GAMMA}) * ce * w) AS focal_sum,
       count(*) AS n
FROM ce
""")
def loss_report(spark, sf_dir):
    return E.loss_report(_logits(spark, sf_dir), "logits", "label", LOSS_WEIGHTS, GAMMA)
