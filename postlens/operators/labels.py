"""Label repair: corrections, upserts, leakage, cluster
review scores, purity and majority propagation, review queues and review exports.

Per-cluster statistics are ordinary aggregates (partial + final aggregation), joined back to rows
by cluster id — never a window over a whole cluster, so a cluster holding a third of all rows is
still processed in parallel.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlens.operators.sampling import exact_rank, hash_key, uniform_bucket

UNCORRECTED, CORRECTED = "uncorrected", "corrected"


# ---------------------------------------------------------------- D1–D4: corrections and joins

def last_per_id(df: DataFrame, id_col: str, value_col: str, order_col: str | None = None) -> DataFrame:
    """``_id`` (as string), ``_value``: the value of the last row of each id by ``order_col``, larger
    values winning ties (without an order, the largest value).  An ordinary aggregate, so an id
    corrected very often is no hot task."""
    value = F.col(value_col)
    order = F.struct(F.col(order_col), value) if order_col else value
    return df.groupBy(F.col(id_col).cast("string").alias("_id")).agg(F.max_by(value, order).alias("_value"))


def apply_corrections(df: DataFrame, corrections: DataFrame, id_col: str, label_col: str,
                      new_label_col: str | None = None, as_bool: bool = False,
                      order_col: str | None = None) -> DataFrame:
    """Overwrite ``label_col`` with the correction for the same id (ids compared as strings; of
    several the last by ``order_col``); rows without a correction keep their label.  ``as_bool`` casts
    the result to BOOLEAN."""
    new_label_col = new_label_col or label_col
    corr = last_per_id(corrections, id_col, new_label_col, order_col).withColumnsRenamed({"_id": "_cid", "_value": "_new"})
    out = df.join(corr, F.col(id_col).cast("string") == F.col("_cid"), "left")
    label = F.coalesce(F.col("_new").cast(df.schema[label_col].dataType), F.col(label_col))
    if as_bool:
        label = F.coalesce(F.col("_new").cast("boolean"), F.col(label_col).cast("boolean"))
    return out.withColumn(label_col, label).drop("_cid", "_new")


def changed_corrections(review: DataFrame, id_col: str, label_col: str,
                        original_col: str = "original_label") -> DataFrame:
    """D1 (a): review rows whose label differs from the original label (missing original = −1)."""
    orig = F.coalesce(F.col(original_col), F.lit(-1)) if original_col in review.columns else F.lit(-1)
    return review.where(F.col(label_col) != orig).select(id_col, label_col)


def attach_predictions(df: DataFrame, preds: DataFrame, id_col: str, pred_col: str = "pred",
                       default: int = -1, order_col: str | None = None) -> DataFrame:
    """Every row gets the predicted class of its id (of several the last by ``order_col``),
    else ``default``."""
    p = last_per_id(preds, id_col, pred_col, order_col).withColumnsRenamed({"_id": "_pid", "_value": "_pred"})
    out = df.join(p, F.col(id_col).cast("string") == F.col("_pid"), "left")
    return out.withColumn(pred_col, F.coalesce(F.col("_pred"), F.lit(default))).drop("_pid", "_pred")


def upsert_corrections(train: DataFrame, corrections: DataFrame, source: DataFrame, id_col: str,
                       label_col: str, current_col: str = "current_label",
                       original_col: str = "original_label",
                       set_true: str | None = "relevant", order_col: str | None = None) -> DataFrame:
    """D3: of several corrections of an id keep the last by ``order_col``; keep changed corrections; update their ids in ``train``; take ids not in ``train``
    from ``source`` with the new label (and ``set_true`` = TRUE), align to train's columns, append."""
    changed = last_per_id(corrections.where(F.col(original_col) != F.col(current_col)), id_col, current_col, order_col) \
        .withColumnsRenamed({"_id": id_col, "_value": "_new"})
    t = train.withColumn("_sid", F.col(id_col).cast("string"))
    updated = (t.join(changed, t["_sid"] == changed[id_col], "left")
               .withColumn(label_col, F.coalesce(F.col("_new").cast(train.schema[label_col].dataType),
                                                 F.col(label_col)))
               .select(*[t[c] if c != label_col else F.col(label_col) for c in train.columns]))
    new_ids = changed.join(train.select(F.col(id_col).cast("string").alias(id_col)), id_col, "left_anti")
    s = source.withColumn("_sid", F.col(id_col).cast("string"))
    # an id that the source holds several times is taken once: the least of its rows
    rest = [c for c in s.columns if c != "_sid"]
    s = s.groupBy("_sid").agg(F.min(F.struct(*rest)).alias("_first")).select("_sid", "_first.*")
    added = s.join(new_ids, s["_sid"] == new_ids[id_col], "inner") \
        .withColumn(label_col, F.col("_new").cast(train.schema[label_col].dataType))
    if set_true and set_true in train.columns:
        added = added.withColumn(set_true, F.lit(True))
    added = added.select(*[s[c] if c not in (label_col, set_true) else F.col(c) for c in train.columns])
    return updated.unionByName(added)


# ---------------------------------------------------------------- D5, D6: exclusion, leakage

def exclude_seen(pool: DataFrame, seen: Iterable[DataFrame], col: str) -> DataFrame:
    """Rows of ``pool`` whose ``col`` value occurs in none of the ``seen`` tables."""
    out = pool
    for s in seen:
        out = out.join(s.select(col).distinct(), col, "left_anti")
    return out


def overlap_values(a: DataFrame, b: DataFrame, col: str) -> DataFrame:
    """Distinct values of ``col`` present in both tables."""
    return a.select(col).distinct().join(b.select(col).distinct(), col, "left_semi")


def leakage_report(train: DataFrame, test: DataFrame, col: str) -> DataFrame:
    """Distinct overlapping values, train row count and overlap as % of train rows.
    One join and one aggregate (no cross join of counts)."""
    flag = test.select(col).distinct().withColumn("_in_test", F.lit(True))
    t = train.groupBy(col).agg(F.count(F.lit(1)).alias("_n")).join(flag, col, "left")    # equal texts are one row
    agg = t.agg(F.count(F.when(F.col("_in_test"), 1)).alias("overlap_count"),
                F.coalesce(F.sum("_n"), F.lit(0)).alias("train_rows"))
    return agg.withColumn("overlap_pct", F.col("overlap_count") * 100.0 / F.col("train_rows"))


# ---------------------------------------------------------------- E12: cluster review (MSS)

def _mode(pred: Column, cnt: Column) -> Column:
    """Most frequent prediction, lowest value on ties (from (pred, count) rows)."""
    return F.max_by(pred, F.struct(cnt, -pred))


def cluster_prediction_breakdown(df: DataFrame, cluster_col: str = "cluster",
                                 label_col: str = "label", pred_col: str = "pred") -> DataFrame:
    """Per cluster: true majority (ties → 1) and minority of a binary label, their sizes, the
    predicted mode and its ratio on each side, and the minority predicted as the majority."""
    c = df.groupBy(cluster_col, label_col, pred_col).agg(F.count(F.lit(1)).alias("_n"))
    lab = F.col(label_col)
    per = c.groupBy(cluster_col).agg(
        F.sum(F.when(lab == 1, F.col("_n")).otherwise(0)).alias("rel"),
        F.sum(F.when(lab == 0, F.col("_n")).otherwise(0)).alias("irrel"))
    per = per.withColumn("majority_true_label", F.when(F.col("rel") >= F.col("irrel"), 1).otherwise(0)) \
             .withColumn("minority_true_label", 1 - F.col("majority_true_label"))
    x = c.join(per, cluster_col, "inner")
    side_maj = lab == F.col("majority_true_label")
    side_min = lab == F.col("minority_true_label")
    stats = x.groupBy(cluster_col, "majority_true_label", "minority_true_label").agg(
        F.sum(F.when(side_maj, F.col("_n")).otherwise(0)).cast("long").alias("majority_count"),
        F.sum(F.when(side_min, F.col("_n")).otherwise(0)).cast("long").alias("minority_count"),
        F.sum(F.when(side_min & (F.col(pred_col) == F.col("majority_true_label")), F.col("_n"))
              .otherwise(0)).cast("long").alias("misclassified_as_majority"),
        _mode(F.when(side_maj, F.col(pred_col)), F.when(side_maj, F.col("_n"))).alias("majority_pred_mode"),
        F.max(F.when(side_maj, F.col("_n"))).alias("_maj_mode_n"),
        _mode(F.when(side_min, F.col(pred_col)), F.when(side_min, F.col("_n"))).alias("minority_pred_mode"),
        F.max(F.when(side_min, F.col("_n"))).alias("_min_mode_n"),
    )
    stats = stats.withColumn("majority_pred_ratio", F.col("_maj_mode_n") / F.col("majority_count")) \
                 .withColumn("minority_pred_ratio", F.col("_min_mode_n") / F.col("minority_count"))
    return stats.drop("_maj_mode_n", "_min_mode_n")


def cluster_review(df: DataFrame, cluster_col: str = "cluster", label_col: str = "label",
                   pred_col: str = "pred", min_minority: int = 5, top: int | None = 5) -> DataFrame:
    """Misclassification severity score per cluster = (minority predicted as the majority /
    minority size) × √(minority size); clusters with minority < ``min_minority`` skipped, score > 0
    kept, top ``top`` by score (ties → cluster id)."""
    b = cluster_prediction_breakdown(df, cluster_col, label_col, pred_col)
    b = b.where(F.col("minority_count") >= min_minority)
    b = b.withColumn("misclassification_ratio",
                     F.col("misclassified_as_majority") / F.col("minority_count"))
    b = b.withColumn("mss_score", F.col("misclassification_ratio") * F.sqrt(F.col("minority_count")))
    b = b.where(F.col("mss_score") > 0).select(
        cluster_col, "mss_score", "misclassification_ratio", "minority_count",
        "minority_true_label", "majority_true_label")
    b = b.orderBy(F.desc("mss_score"), F.asc(cluster_col))
    return b.limit(top) if top else b


# ---------------------------------------------------------------- E13–E16: cluster tables

def cluster_breakdown(df: DataFrame, cluster_col: str = "cluster", label_col: str = "sentiment",
                      classes: Iterable[int] = (0, 1, 2)) -> DataFrame:
    """Count of each class per cluster, zero-filled."""
    classes = list(classes)
    lab = F.col(label_col)
    return df.groupBy(cluster_col).agg(*[
        F.count(F.when(lab == k, 1)).alias(f"count_{k}") for k in classes])


def minority_flag(df: DataFrame, cluster_col: str = "cluster", label_col: str = "sentiment",
                  unlabelled: int = -1) -> DataFrame:
    """Dominant label per cluster (−1 ignored; ties → lowest label); labelled rows that
    differ from it get ``needs_check`` = TRUE.  Clusters with no labelled row have no dominant."""
    lab = F.col(label_col)
    counts = (df.where(lab != unlabelled).groupBy(cluster_col, label_col)
              .agg(F.count(F.lit(1)).alias("_n")))
    dom = counts.groupBy(cluster_col).agg(
        F.max_by(F.col(label_col), F.struct(F.col("_n"), -F.col(label_col))).alias("dominant_label"))
    out = df.join(dom, cluster_col, "left")
    flag = (lab != unlabelled) & F.col("dominant_label").isNotNull() & (lab != F.col("dominant_label"))
    return out.withColumn("needs_check", F.coalesce(flag, F.lit(False)))


def cluster_majority(df: DataFrame, cluster_col: str, label_col: str,
                     classes: tuple[int, ...] = (0, 1)) -> DataFrame:
    """Majority label per cluster over all rows.  Binary: 1 when count(1) >= count(0); more
    classes: the first class (ascending) with the strictly highest count."""
    lab = F.col(label_col)
    agg = df.groupBy(cluster_col).agg(
        F.count(F.lit(1)).alias("size"),
        *[F.count(F.when(lab == k, 1)).alias(f"_c{k}") for k in classes],
        F.count(F.when(F.col("status") == UNCORRECTED, 1)).alias("uncorrected"))
    if classes == (0, 1):
        maj = F.when(F.col("_c1") >= F.col("_c0"), 1).otherwise(0)
    else:
        best = F.greatest(*[F.col(f"_c{k}") for k in classes])
        maj = None
        for k in classes:
            cond = F.col(f"_c{k}") == best
            maj = F.when(cond, k) if maj is None else maj.when(cond, k)
    agg = agg.withColumn("majority", maj)
    maj_count = None
    for k in classes:
        maj_count = (F.when(F.col("majority") == k, F.col(f"_c{k}")) if maj_count is None
                     else maj_count.when(F.col("majority") == k, F.col(f"_c{k}")))
    agg = agg.withColumn("_maj_n", maj_count)
    return agg


def cluster_purity(df: DataFrame, cluster_col: str = "cluster", label_col: str = "relevant",
                   classes: tuple[int, ...] = (0, 1)) -> DataFrame:
    """Per cluster size, majority, purity % (rounded half up), rows left to review and a
    complete flag (every row corrected)."""
    m = cluster_majority(df, cluster_col, label_col, classes)
    purity = F.when(F.col("size") > 0, F.round(F.col("_maj_n") * 100.0 / F.col("size"))).otherwise(0)
    return m.select(cluster_col, "size", "majority", purity.cast("long").alias("purity"),
                    "uncorrected", (F.col("uncorrected") == 0).alias("complete"))


def review_progress(purity: DataFrame) -> DataFrame:
    """Completed clusters / all clusters."""
    return purity.agg(F.count(F.when(F.col("complete"), 1)).alias("done"),
                      F.count(F.lit(1)).alias("total"))


def majority_propagate(df: DataFrame, cluster_col: str = "cluster", label_col: str = "relevant",
                       classes: tuple[int, ...] = (0, 1)) -> DataFrame:
    """Every uncorrected row takes its cluster's majority (computed on all rows) and is
    marked corrected."""
    m = cluster_majority(df, cluster_col, label_col, classes).select(cluster_col, "majority")
    out = df.join(m, cluster_col, "left")
    unc = F.col("status") == UNCORRECTED
    return (out.withColumn(label_col, F.when(unc, F.col("majority")).otherwise(F.col(label_col)))
            .withColumn("status", F.when(unc, F.lit(CORRECTED)).otherwise(F.col("status")))
            .drop("majority"))


# ---------------------------------------------------------------- B8, B10: review queue, highlight

def review_queue(df: DataFrame, cluster, query: str = "", label_filter: str = "all",
                 label_col: str = "relevant", id_col: str = "id", cluster_col: str = "cluster",
                 n: int = 100) -> DataFrame:
    """Rows of one cluster whose content contains ``query`` (case-insensitive), filtered by
    label ('all', 'uncorrected' or a label value); uncorrected first, then by id; first n."""
    x = df.where(F.col(cluster_col) == F.lit(cluster))
    if query:
        x = x.where(F.lower(F.col("content")).contains(query.lower()))
    if label_filter == "uncorrected":
        x = x.where(F.col("status") == UNCORRECTED)
    elif label_filter != "all":
        x = x.where(F.col(label_col) == F.lit(int(label_filter)))
    order = [F.when(F.col("status") == UNCORRECTED, 0).otherwise(1), F.col(id_col)]
    return x.orderBy(*order).limit(n)


def highlight(c: Column, query: str, left: str = "<mark>", right: str = "</mark>") -> Column:
    """Wrap every case-insensitive occurrence of ``query`` (taken literally) in markers."""
    pattern = "(?i)(\\Q" + query.replace("\\E", "\\E\\\\E\\Q") + "\\E)"
    rep = left.replace("$", "\\$") + "$1" + right.replace("$", "\\$")
    return F.regexp_replace(c, pattern, rep)


# ---------------------------------------------------------------- A4–A6: review exports

# The leading column order of the flat review export.
FLAT_ORDER = ("id", "cluster", "probability", "content", "relevant", "original_label", "status")
# Metadata columns and their defaults when the dataset lacks them.
FLAT_DEFAULTS = (("author", "Unknown"), ("comment_count", 0), ("repost_count", 0),
                 ("like_count", 0), ("view_count", 0))


def review_export_flat(df: DataFrame, label_col: str = "relevant") -> DataFrame:
    """A5: add ``original_label`` (= current label) and ``status`` = 'uncorrected', fill missing
    metadata with defaults, put the app's columns first.  Write with ``df.write.json``."""
    out = df.withColumn("original_label", F.col(label_col)).withColumn("status", F.lit(UNCORRECTED))
    if label_col != "relevant" and "relevant" not in out.columns:
        out = out.withColumn("relevant", F.col(label_col))
    for c, v in FLAT_DEFAULTS:
        if c not in out.columns:
            out = out.withColumn(c, F.lit(v))
    if "tweet_id" not in out.columns:
        out = out.withColumn("tweet_id", F.col("id").cast("string"))
    lead = [c for c in FLAT_ORDER if c in out.columns]
    return out.select(*lead, *[c for c in out.columns if c not in lead])


def review_export_stats(df: DataFrame, cluster_col: str = "cluster", label_col: str = "sentiment",
                        unlabelled: int = -1) -> DataFrame:
    """A6 (stats part): per cluster its size and the count of each label, −1 excluded."""
    size = df.groupBy(cluster_col).agg(F.count(F.lit(1)).alias("size"))
    labs = (df.where(F.col(label_col) != unlabelled).groupBy(cluster_col, label_col)
            .agg(F.count(F.lit(1)).alias("cnt")))
    return size.join(labs, cluster_col, "left").select(
        F.col(cluster_col).alias("cluster_id"), "size", F.col(label_col).alias("label"), "cnt")


def review_export_nested(df: DataFrame, cluster_col: str = "cluster", label_col: str = "sentiment",
                         id_col: str = "tweet_id", chunk: int = 10000, seed: int = 42) -> DataFrame:
    """Cluster blocks ``{cluster_id, chunk, stats{size, labels}, samples[]}`` for the review
    app, one JSON line per block.  Output contract: a cluster of at most ``chunk`` rows is one block
    (chunk 0); a larger one is several, numbered from 0 in rank order (rank by hash key), each with the
    whole cluster's stats, so no task ever holds a whole large cluster.  ``flatten_review`` reads both."""
    flagged = minority_flag(df, cluster_col, label_col)
    sample = F.struct(
        F.col(id_col).cast("string").alias("tweet_id"), F.col("content"),
        F.col("author") if "author" in df.columns else F.lit(None).cast("string").alias("author"),
        (F.col("time").cast("string") if "time" in df.columns else F.lit(None).cast("string")).alias("time"),
        F.col("probability").cast("double").alias("cluster_probability"),
        F.col(label_col).alias("original_label"), F.col(label_col).alias("current_label"),
        (F.col(label_col) == -1).alias("is_unlabeled"), F.col("needs_check"))
    x = flagged.withColumn("_key", hash_key(id_col, seed))
    x = exact_rank(x, ["_key", id_col], uniform_bucket(F.col("_key")), by=[cluster_col])
    x = x.withColumn("chunk", ((F.col("rank") - 1) / chunk).cast("long"))
    blocks = x.groupBy(cluster_col, "chunk").agg(
        F.sort_array(F.collect_list(F.struct(F.col("rank"), sample.alias("s")))).alias("_s"))
    blocks = blocks.withColumn("samples", F.transform("_s", lambda e: e["s"])).drop("_s")
    st = review_export_stats(df, cluster_col, label_col)
    stats = st.groupBy("cluster_id", "size").agg(
        F.map_from_entries(F.collect_list(F.when(
            F.col("label").isNotNull(),
            F.struct(F.col("label").cast("string"), F.col("cnt"))))).alias("labels"))
    out = blocks.join(stats, blocks[cluster_col] == stats["cluster_id"], "inner")
    return out.select("cluster_id", "chunk", F.struct("size", "labels").alias("stats"), "samples")


def review_metadata(df: DataFrame, cluster_col: str = "cluster") -> DataFrame:
    """A6 metadata record: version, generation time, number of clusters and samples."""
    return df.agg(F.lit(1).alias("version"),
                  F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss").alias("generated_at"),
                  F.count_distinct(cluster_col).alias("num_clusters"),
                  F.count(F.lit(1)).alias("num_samples"))


def flatten_review(nested: DataFrame) -> DataFrame:
    """A4: cluster blocks → one row per sample (with its cluster id)."""
    c = nested.select(F.col("cluster_id"), F.explode("samples").alias("s"))
    return c.select("cluster_id", "s.*")
