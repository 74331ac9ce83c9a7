"""Classifier evaluation.

The data pass is one aggregate: ``groupBy(label, pred).count()`` (plus optional grouping keys such
as a cluster).  Everything else — precision, recall, F1, macro and weighted averages, confusion
matrix — is computed on that small confusion table, whose size is bounded by classes² (× groups),
not by the number of predictions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def class_counts(df: DataFrame, label_col: str = "label") -> DataFrame:
    """Frequency of each label."""
    return df.groupBy(label_col).agg(F.count(F.lit(1)).alias("count"))


def confusion_counts(df: DataFrame, label_col: str = "label", pred_col: str = "pred",
                     by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by, label_col, pred_col).agg(F.count(F.lit(1)).alias("n"))


def per_class_metrics(df: DataFrame, classes: Sequence[int], label_col: str = "label",
                      pred_col: str = "pred", by: Sequence[str] = (),
                      names: Sequence[str] | None = None) -> DataFrame:
    """E7 (per class): precision, recall, F1 and support of every listed class (zero_division=0).
    F1 = 2·tp / (support + predicted), the count form of 2PR/(P+R)."""
    by = list(by)
    cm = confusion_counts(df, label_col, pred_col, by)
    cls = F.array(*[F.lit(int(c)) for c in classes])
    x = cm.withColumn("class", F.explode(cls))
    lab, pred, n = F.col(label_col), F.col(pred_col), F.col("n")
    agg = x.groupBy(*by, "class").agg(
        F.sum(F.when((lab == F.col("class")) & (pred == F.col("class")), n).otherwise(0)).alias("tp"),
        F.sum(F.when(lab == F.col("class"), n).otherwise(0)).alias("support"),
        F.sum(F.when(pred == F.col("class"), n).otherwise(0)).alias("predicted"))

    def div(a: Column, b: Column) -> Column:
        return F.coalesce(F.try_divide(a, b), F.lit(0.0))

    out = agg.select(*by, "class",
                     div(F.col("tp"), F.col("predicted")).alias("precision"),
                     div(F.col("tp"), F.col("support")).alias("recall"),
                     div(2 * F.col("tp"), F.col("support") + F.col("predicted")).alias("f1"),
                     F.col("support").cast("long").alias("support"),
                     F.col("predicted").cast("long").alias("predicted"))
    if names:
        lookup = F.create_map(*[v for c, nm in zip(classes, names) for v in (F.lit(int(c)), F.lit(nm))])
        out = out.withColumn("name", lookup[F.col("class")])
    return out


def summary_metrics(df: DataFrame, classes: Sequence[int], label_col: str = "label",
                    pred_col: str = "pred", by: Sequence[str] = ()) -> DataFrame:
    """E7 (summary): accuracy and macro precision / recall / F1.  The macro average covers the
    labels present in truth or prediction (as scikit-learn does without ``labels``)."""
    by = list(by)
    pc = per_class_metrics(df, classes, label_col, pred_col, by)
    cm = confusion_counts(df, label_col, pred_col, by)
    acc = cm.groupBy(*by).agg(
        (F.sum(F.when(F.col(label_col) == F.col(pred_col), F.col("n")).otherwise(0))
         / F.sum("n")).alias("accuracy"),
        F.sum("n").cast("long").alias("support"))
    seen = (F.col("support") + F.col("predicted")) > 0
    macro = pc.groupBy(*by).agg(
        F.avg(F.when(seen, F.col("precision"))).alias("macro_precision"),
        F.avg(F.when(seen, F.col("recall"))).alias("macro_recall"),
        F.avg(F.when(seen, F.col("f1"))).alias("macro_f1"))
    return acc.join(macro, by, "inner") if by else _join_single(acc, macro)


def _join_single(a: DataFrame, b: DataFrame) -> DataFrame:
    """Join two one-row aggregates on a constant key (no cross join)."""
    return a.withColumn("_k", F.lit(1)).join(b.withColumn("_k", F.lit(1)), "_k").drop("_k")


def weighted_metrics(per_class: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Σ metric·support / Σ support; no row when the total support is zero."""
    by = list(by)
    s = F.col("support")
    out = per_class.groupBy(*by).agg(
        F.try_divide(F.sum(F.col("precision") * s), F.sum(s)).alias("weighted_precision"),
        F.try_divide(F.sum(F.col("recall") * s), F.sum(s)).alias("weighted_recall"),
        F.try_divide(F.sum(F.col("f1") * s), F.sum(s)).alias("weighted_f1"),
        F.sum(s).cast("long").alias("total_support"))
    return out.where(F.col("total_support") > 0)


def confusion_matrix(df: DataFrame, classes: Sequence[int], label_col: str = "label",
                     pred_col: str = "pred") -> DataFrame:
    """One row per actual class, one count column per predicted class, zero-filled."""
    cm = confusion_counts(df, label_col, pred_col)
    cols = [F.sum(F.when(F.col(pred_col) == k, F.col("n")).otherwise(0)).cast("long").alias(f"pred_{k}")
            for k in classes]
    rows = cm.groupBy(label_col).agg(*cols)
    spark = df.sparkSession
    spine = spark.createDataFrame([(int(k),) for k in classes], f"{label_col} INT")
    return spine.join(rows, label_col, "left").na.fill(0)


def classification_report(df: DataFrame, classes: Sequence[int], names: Sequence[str] | None = None,
                          label_col: str = "label", pred_col: str = "pred") -> DataFrame:
    """Per-class rows, then 'accuracy', 'macro avg' and 'weighted avg' rows."""
    names = list(names) if names else [str(c) for c in classes]
    pc = per_class_metrics(df, classes, label_col, pred_col, names=names)
    rows = pc.select(F.col("name").alias("row"), "precision", "recall", "f1", "support")
    sm = summary_metrics(df, classes, label_col, pred_col)
    wm = weighted_metrics(pc)
    acc = sm.select(F.lit("accuracy").alias("row"), F.lit(None).cast("double").alias("precision"),
                    F.lit(None).cast("double").alias("recall"), F.col("accuracy").alias("f1"), "support")
    mac = sm.select(F.lit("macro avg").alias("row"), F.col("macro_precision").alias("precision"),
                    F.col("macro_recall").alias("recall"), F.col("macro_f1").alias("f1"), "support")
    wei = wm.select(F.lit("weighted avg").alias("row"), F.col("weighted_precision").alias("precision"),
                    F.col("weighted_recall").alias("recall"), F.col("weighted_f1").alias("f1"),
                    F.col("total_support").alias("support"))
    return rows.unionByName(acc).unionByName(mac).unionByName(wei)


def error_table(df: DataFrame, label_col: str = "label", pred_col: str = "pred") -> DataFrame:
    """Misclassified rows tagged FP (truth 0, predicted 1) or FN (truth 1, predicted 0)."""
    lab, pred = F.col(label_col), F.col(pred_col)
    kind = (F.when((lab == 0) & (pred == 1), F.lit("False Positive (FP)"))
            .when((lab == 1) & (pred == 0), F.lit("False Negative (FN)")))
    return df.where(lab != pred).withColumn("error_type", kind)


def class_weights(df: DataFrame, label_col: str = "label", mode: str = "balanced",
                  classes: Sequence[int] = (0, 1, 2)) -> DataFrame:
    """``binary``: weight of class 0 = share of class 1 and vice versa;
    ``balanced``: N / (K · count_k) over the listed classes."""
    counts = class_counts(df, label_col)
    cls = list(classes) if mode == "balanced" else [0, 1]
    cnt = {k: F.sum(F.when(F.col(label_col) == k, F.col("count")).otherwise(0)) for k in cls}
    total = F.sum(F.when(F.col(label_col).isin(*cls), F.col("count")).otherwise(0))
    if mode == "binary":
        exprs = [F.try_divide(cnt[1], total).alias("w_0"), F.try_divide(cnt[0], total).alias("w_1")]
    elif mode == "balanced":
        exprs = [F.try_divide(total, F.lit(len(cls)) * cnt[k]).alias(f"w_{k}") for k in cls]
    else:
        raise ValueError(f"unknown weighting mode {mode!r}")
    wide = counts.agg(*exprs)
    return wide.select(F.explode(F.array(*[
        F.struct(F.lit(int(k)).alias("class"), F.col(f"w_{k}").alias("weight")) for k in cls])).alias("w")) \
        .select("w.*")


# ---------------------------------------------------------------- C20, E19: scores and losses

def softmax(logits: Column) -> Column:
    """C20: numerically stable softmax of an array of logits."""
    m = F.array_max(logits)
    ex = F.transform(logits, lambda x: F.exp(x - m))
    total = F.aggregate(ex, F.lit(0.0), lambda a, b: a + b)
    return F.transform(ex, lambda e: e / total)


def argmax(arr: Column) -> Column:
    """C20: 0-based index of the first maximum."""
    return (F.array_position(arr, F.array_max(arr)) - 1).cast("int")


def score_columns(df: DataFrame, logits_col: str = "logits", n_classes: int | None = None,
                  prefix: str = "prob_") -> DataFrame:
    """C20: probabilities, predicted class, confidence, and one column per class."""
    out = df.withColumn("probabilities", softmax(F.col(logits_col)))
    out = out.withColumn("pred", argmax(F.col("probabilities"))) \
             .withColumn("confidence", F.array_max("probabilities"))
    for k in range(n_classes or 0):
        out = out.withColumn(f"{prefix}{k}", F.col("probabilities")[k])
    return out


def _ce(logits: Column, label: Column) -> Column:
    """Per-row cross entropy −log softmax(logits)[label] via log-sum-exp."""
    m = F.array_max(logits)
    lse = m + F.log(F.aggregate(F.transform(logits, lambda x: F.exp(x - m)), F.lit(0.0),
                                lambda a, b: a + b))
    return lse - F.element_at(logits, label + 1)


def loss_report(df: DataFrame, logits_col: str = "logits", label_col: str = "label",
                weights: Sequence[float] | None = None, gamma: float = 2.0) -> DataFrame:
    """Mean CE, class-weighted CE (Σ w·ce / Σ w), focal loss (1−p)^γ·ce·α mean and sum."""
    lab = F.col(label_col)
    ce = _ce(F.col(logits_col), lab)
    x = df.select(ce.alias("ce"), lab.alias("_y"))
    w = F.element_at(F.array(*[F.lit(float(v)) for v in weights]), F.col("_y") + 1) if weights \
        else F.lit(1.0)
    focal = F.pow(F.lit(1.0) - F.exp(-F.col("ce")), F.lit(gamma)) * F.col("ce") * w
    return x.agg(F.avg("ce").alias("ce_mean"),
                 (F.sum(w * F.col("ce")) / F.sum(w)).alias("weighted_ce"),
                 F.avg(focal).alias("focal_mean"), F.sum(focal).alias("focal_sum"),
                 F.count(F.lit(1)).alias("n"))
