"""Catalogue: label repair over ``labels`` ⋈ ``documents``.

Mapping: cluster = the number of the document's ``source`` (20 sources), truth = ``quality``,
prediction = ``toxic``, probability = n_chars / (n_chars + 1000), review status = corrected for
English documents, uncorrected otherwise.  The three-class table covers all documents: unlabelled
ones get −1, toxic → 0, quality → 2, else 1.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from postlens.operators import labels as L
from postlens.operators import sampling as S
from postlens.plans.registry import register
from postlens.sources.tables import POSTS_SQL, posts_from_documents, table

SEED = 42


def _review(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    lab = table(spark, sf_dir, "labels")
    posts = posts_from_documents(spark, sf_dir).select("tweet_id", "content")
    x = lab.join(docs, "doc_id").join(posts, F.col("doc_id") == F.col("tweet_id"))
    return x.select(
        F.col("doc_id").alias("id"),
        F.substring(F.col("source"), 4, 10).cast("int").alias("cluster"),
        (F.col("n_chars") / (F.col("n_chars") + F.lit(1000.0))).alias("probability"),
        F.col("content"), F.col("quality").alias("relevant"), F.col("toxic").alias("pred"),
        F.when(F.col("lang") == "en", F.lit(L.CORRECTED)).otherwise(F.lit(L.UNCORRECTED)).alias("status"),
        F.col("source").alias("author"))


_REVIEW_SQL = f"""
p AS ({POSTS_SQL}),
rv AS (
  SELECT d.doc_id AS id, CAST(substr(d.source, 4, 10) AS INTEGER) AS cluster,
         d.n_chars / (d.n_chars + 1000.0) AS probability, p.content, l.quality AS relevant,
         l.toxic AS pred, CASE WHEN d.lang = 'en' THEN 'corrected' ELSE 'uncorrected' END AS status,
         d.source AS author
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id JOIN p ON p.tweet_id = d.doc_id)
"""


def _sentiment(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    lab = table(spark, sf_dir, "labels")
    posts = posts_from_documents(spark, sf_dir).select("tweet_id", "content")
    x = docs.join(lab, "doc_id", "left").join(posts, F.col("doc_id") == F.col("tweet_id"))
    sent = (F.when(F.col("quality").isNull(), -1).when(F.col("toxic") == 1, 0)
            .when(F.col("quality") == 1, 2).otherwise(1))
    return x.select(
        F.col("doc_id").alias("tweet_id"),
        F.substring(F.col("source"), 4, 10).cast("int").alias("cluster"),
        (F.col("n_chars") / (F.col("n_chars") + F.lit(1000.0))).alias("probability"),
        F.col("content"), F.col("source").alias("author"), sent.alias("sentiment"),
        F.when(F.col("lang") == "en", F.lit(L.CORRECTED)).otherwise(F.lit(L.UNCORRECTED)).alias("status"))


_SENT_SQL = f"""
p AS ({POSTS_SQL}),
sv AS (
  SELECT d.doc_id AS tweet_id, CAST(substr(d.source, 4, 10) AS INTEGER) AS cluster,
         d.n_chars / (d.n_chars + 1000.0) AS probability, p.content, d.source AS author,
         CASE WHEN l.quality IS NULL THEN -1 WHEN l.toxic = 1 THEN 0 WHEN l.quality = 1 THEN 2 ELSE 1 END AS sentiment,
         CASE WHEN d.lang = 'en' THEN 'corrected' ELSE 'uncorrected' END AS status
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id JOIN p ON p.tweet_id = d.doc_id)
"""


@register("cluster_review_mss", f"""
WITH {_REVIEW_SQL},
c AS (SELECT cluster, count(CASE WHEN relevant = 1 THEN 1 END) AS rel,
             count(CASE WHEN relevant = 0 THEN 1 END) AS irrel FROM rv GROUP BY cluster),
m AS (SELECT cluster, CASE WHEN rel >= irrel THEN 1 ELSE 0 END AS majority_true_label,
             CASE WHEN rel >= irrel THEN 0 ELSE 1 END AS minority_true_label FROM c),
s AS (SELECT m.cluster, m.majority_true_label, m.minority_true_label,
             count(CASE WHEN rv.relevant = m.minority_true_label THEN 1 END) AS minority_count,
             count(CASE WHEN rv.relevant = m.minority_true_label AND rv.pred = m.majority_true_label THEN 1 END) AS mis
      FROM rv JOIN m USING (cluster) GROUP BY ALL),
r AS (SELECT cluster, mis / minority_count AS misclassification_ratio, minority_count,
             minority_true_label, majority_true_label FROM s WHERE minority_count >= 5)
SELECT cluster, misclassification_ratio * sqrt(minority_count) AS mss_score, misclassification_ratio,
       minority_count, minority_true_label, majority_true_label
FROM r WHERE misclassification_ratio * sqrt(minority_count) > 0
ORDER BY mss_score DESC, cluster ASC LIMIT 5
""")
def cluster_review_mss(spark, sf_dir):
    return L.cluster_review(_review(spark, sf_dir), "cluster", "relevant", "pred")


@register("cluster_pred_breakdown", f"""
WITH {_REVIEW_SQL},
c AS (SELECT cluster, count(CASE WHEN relevant = 1 THEN 1 END) AS rel,
             count(CASE WHEN relevant = 0 THEN 1 END) AS irrel FROM rv GROUP BY cluster),
m AS (SELECT cluster, CASE WHEN rel >= irrel THEN 1 ELSE 0 END AS majority_true_label,
             CASE WHEN rel >= irrel THEN 0 ELSE 1 END AS minority_true_label FROM c),
x AS (SELECT rv.*, m.majority_true_label, m.minority_true_label FROM rv JOIN m USING (cluster)),
side AS (SELECT cluster, CASE WHEN relevant = majority_true_label THEN 'maj'
                              WHEN relevant = minority_true_label THEN 'min' END AS side,
                pred, count(*) AS n FROM x GROUP BY ALL),
mode AS (SELECT cluster, side, pred AS mode_pred, n AS mode_n, sum(n) OVER (PARTITION BY cluster, side) AS side_n
         FROM (SELECT *, row_number() OVER (PARTITION BY cluster, side ORDER BY n DESC, pred ASC) AS rn FROM side)
         WHERE rn = 1),
cnt AS (SELECT cluster, majority_true_label, minority_true_label,
               CAST(count(CASE WHEN relevant = majority_true_label THEN 1 END) AS BIGINT) AS majority_count,
               CAST(count(CASE WHEN relevant = minority_true_label THEN 1 END) AS BIGINT) AS minority_count,
               CAST(count(CASE WHEN relevant = minority_true_label AND pred = majority_true_label THEN 1 END) AS BIGINT)
                 AS misclassified_as_majority
        FROM x GROUP BY ALL)
SELECT cnt.*, a.mode_pred AS majority_pred_mode, b.mode_pred AS minority_pred_mode,
       a.mode_n / cnt.majority_count AS majority_pred_ratio, b.mode_n / cnt.minority_count AS minority_pred_ratio
FROM cnt LEFT JOIN mode a ON a.cluster = cnt.cluster AND a.side = 'maj'
         LEFT JOIN mode b ON b.cluster = cnt.cluster AND b.side = 'min'
""")
def cluster_pred_breakdown(spark, sf_dir):
    return L.cluster_prediction_breakdown(_review(spark, sf_dir), "cluster", "relevant", "pred")


@register("cluster_breakdown", f"""
WITH {_SENT_SQL}
SELECT cluster, count(CASE WHEN sentiment = 0 THEN 1 END) AS count_0,
       count(CASE WHEN sentiment = 1 THEN 1 END) AS count_1,
       count(CASE WHEN sentiment = 2 THEN 1 END) AS count_2
FROM sv GROUP BY cluster
""")
def cluster_breakdown(spark, sf_dir):
    return L.cluster_breakdown(_sentiment(spark, sf_dir), "cluster", "sentiment")


@register("minority_flag", f"""
WITH {_SENT_SQL},
c AS (SELECT cluster, sentiment, count(*) AS n FROM sv WHERE sentiment <> -1 GROUP BY ALL),
d AS (SELECT cluster, sentiment AS dominant_label FROM (
        SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, sentiment ASC) AS rn FROM c)
      WHERE rn = 1)
SELECT sv.tweet_id, sv.cluster, sv.sentiment, d.dominant_label,
       coalesce(sv.sentiment <> -1 AND d.dominant_label IS NOT NULL AND sv.sentiment <> d.dominant_label, FALSE)
         AS needs_check
FROM sv LEFT JOIN d USING (cluster)
""")
def minority_flag(spark, sf_dir):
    out = L.minority_flag(_sentiment(spark, sf_dir), "cluster", "sentiment")
    return out.select("tweet_id", "cluster", "sentiment", "dominant_label", "needs_check")


_PURITY_BIN = """
pc AS (SELECT cluster, count(*) AS size, count(CASE WHEN relevant = 0 THEN 1 END) AS c0,
              count(CASE WHEN relevant = 1 THEN 1 END) AS c1,
              count(CASE WHEN status = 'uncorrected' THEN 1 END) AS uncorrected
       FROM rv GROUP BY cluster),
pm AS (SELECT *, CASE WHEN c1 >= c0 THEN 1 ELSE 0 END AS majority FROM pc),
pur AS (SELECT cluster, size, majority,
               CAST(CASE WHEN size > 0 THEN round((CASE WHEN majority = 1 THEN c1 ELSE c0 END) * 100.0 / size)
                    ELSE 0 END AS BIGINT) AS purity,
               uncorrected, uncorrected = 0 AS complete
        FROM pm)
"""


@register("cluster_purity", f"WITH {_REVIEW_SQL}, {_PURITY_BIN} SELECT * FROM pur")
def cluster_purity(spark, sf_dir):
    return L.cluster_purity(_review(spark, sf_dir), "cluster", "relevant")


@register("cluster_purity_sentiment", f"""
WITH {_SENT_SQL},
pc AS (SELECT cluster, count(*) AS size, count(CASE WHEN sentiment = 0 THEN 1 END) AS c0,
              count(CASE WHEN sentiment = 1 THEN 1 END) AS c1, count(CASE WHEN sentiment = 2 THEN 1 END) AS c2,
              count(CASE WHEN status = 'uncorrected' THEN 1 END) AS uncorrected
       FROM sv GROUP BY cluster),
pm AS (SELECT *, CASE WHEN c0 = greatest(c0, c1, c2) THEN 0 WHEN c1 = greatest(c0, c1, c2) THEN 1 ELSE 2 END
                   AS majority FROM pc)
SELECT cluster, size, majority,
       CAST(round((CASE majority WHEN 0 THEN c0 WHEN 1 THEN c1 ELSE c2 END) * 100.0 / size) AS BIGINT) AS purity,
       uncorrected, uncorrected = 0 AS complete
FROM pm
""")
def cluster_purity_sentiment(spark, sf_dir):
    return L.cluster_purity(_sentiment(spark, sf_dir), "cluster", "sentiment", classes=(0, 1, 2))


@register("review_progress", f"""
WITH {_REVIEW_SQL}, {_PURITY_BIN}
SELECT count(CASE WHEN complete THEN 1 END) AS done, count(*) AS total FROM pur
""")
def review_progress(spark, sf_dir):
    return L.review_progress(L.cluster_purity(_review(spark, sf_dir), "cluster", "relevant"))


_PROP_SQL = f"""
{_REVIEW_SQL}, {_PURITY_BIN},
prop AS (
  SELECT rv.id, rv.cluster, rv.relevant AS original_label,
         CASE WHEN rv.status = 'uncorrected' THEN pur.majority ELSE rv.relevant END AS relevant,
         'corrected' AS status
  FROM rv JOIN pur USING (cluster))
"""


@register("majority_propagate", f"WITH {_PROP_SQL} SELECT id, cluster, relevant, status FROM prop")
def majority_propagate(spark, sf_dir):
    out = L.majority_propagate(_review(spark, sf_dir), "cluster", "relevant")
    return out.select("id", "cluster", "relevant", "status")


@register("apply_corrections", f"""
WITH {_PROP_SQL},
corr AS (SELECT CAST(id AS VARCHAR) AS cid, relevant AS new_label FROM prop WHERE relevant <> original_label)
SELECT l.doc_id, coalesce(CAST(corr.new_label AS BOOLEAN), CAST(l.quality AS BOOLEAN)) AS relevant
FROM labels l LEFT JOIN corr ON CAST(l.doc_id AS VARCHAR) = corr.cid
""")
def apply_corrections(spark, sf_dir):
    prop = L.majority_propagate(_review(spark, sf_dir).withColumn("original_label", F.col("relevant")),
                                "cluster", "relevant")
    corr = L.changed_corrections(prop, "id", "relevant").withColumnRenamed("id", "doc_id")
    lab = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("relevant"))
    return L.apply_corrections(lab, corr, "doc_id", "relevant", as_bool=True)


@register("predictions_default", """
SELECT d.doc_id, coalesce(l.toxic, -1) AS pred
FROM documents d LEFT JOIN labels l ON CAST(d.doc_id AS VARCHAR) = CAST(l.doc_id AS VARCHAR)
""")
def predictions_default(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id")
    preds = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("pred"))
    return L.attach_predictions(docs, preds, "doc_id", "pred")


@register("upsert_corrections", f"""
WITH {_SENT_SQL},
sc AS (SELECT cluster, count(CASE WHEN sentiment = 0 THEN 1 END) AS c0,
              count(CASE WHEN sentiment = 1 THEN 1 END) AS c1, count(CASE WHEN sentiment = 2 THEN 1 END) AS c2
       FROM sv GROUP BY cluster),
sm AS (SELECT cluster, CASE WHEN c0 = greatest(c0, c1, c2) THEN 0 WHEN c1 = greatest(c0, c1, c2) THEN 1 ELSE 2 END
                         AS majority FROM sc),
corr AS (SELECT CAST(sv.tweet_id AS VARCHAR) AS tweet_id, sv.sentiment AS original_label,
                CASE WHEN sv.status = 'uncorrected' THEN sm.majority ELSE sv.sentiment END AS current_label
         FROM sv JOIN sm USING (cluster)),
ch AS (SELECT tweet_id, current_label AS new_label FROM corr WHERE original_label <> current_label),
lk AS (SELECT doc_id, {{S_KEY}} AS key FROM labels),
lr AS (SELECT doc_id, row_number() OVER (ORDER BY key, doc_id) AS rank, count(*) OVER () AS n FROM lk),
tr AS (SELECT CAST(sv.tweet_id AS VARCHAR) AS tweet_id, sv.content, sv.sentiment, TRUE AS relevant
       FROM lr JOIN sv ON sv.tweet_id = lr.doc_id WHERE lr.rank > ceil(lr.n * 0.25 - 1e-9)),
src AS (SELECT CAST(tweet_id AS VARCHAR) AS tweet_id, content, sentiment, FALSE AS relevant FROM sv)
SELECT tr.tweet_id, tr.content, coalesce(ch.new_label, tr.sentiment) AS sentiment, tr.relevant
FROM tr LEFT JOIN ch USING (tweet_id)
UNION ALL
SELECT src.tweet_id, src.content, ch.new_label AS sentiment, TRUE AS relevant
FROM src JOIN ch USING (tweet_id) WHERE ch.tweet_id NOT IN (SELECT tweet_id FROM tr)
""".replace("{S_KEY}", "('0x' || substr(md5('42:' || CAST(doc_id AS VARCHAR)), 1, 15))::BIGINT"))
def upsert_corrections(spark, sf_dir):
    sv = _sentiment(spark, sf_dir)
    prop = L.majority_propagate(sv.withColumn("original_label", F.col("sentiment")),
                                "cluster", "sentiment", classes=(0, 1, 2))
    corr = prop.select(F.col("tweet_id").cast("string").alias("tweet_id"), "original_label",
                       F.col("sentiment").alias("current_label"))
    lab = table(spark, sf_dir, "labels").select("doc_id")
    tr_ids = S.split_exact(lab, "doc_id", test=0.25, seed=SEED).where("split = 'train'")
    base = sv.select(F.col("tweet_id").cast("string").alias("tweet_id"), "content", "sentiment")
    train = (tr_ids.select(F.col("doc_id").cast("string").alias("tweet_id"))
             .join(base, "tweet_id").withColumn("relevant", F.lit(True)))
    source = base.withColumn("relevant", F.lit(False))
    return L.upsert_corrections(train, corr, source, "tweet_id", "sentiment")


@register("review_queue", f"""
WITH {_REVIEW_SQL}
SELECT * FROM rv WHERE cluster = 3 AND contains(lower(content), 'the')
ORDER BY CASE WHEN status = 'uncorrected' THEN 0 ELSE 1 END, id LIMIT 100
""")
def review_queue(spark, sf_dir):
    return L.review_queue(_review(spark, sf_dir), cluster=3, query="the")


@register("review_queue_uncorrected", f"""
WITH {_REVIEW_SQL}
SELECT * FROM rv WHERE cluster = 5 AND status = 'uncorrected'
ORDER BY id LIMIT 100
""")
def review_queue_uncorrected(spark, sf_dir):
    return L.review_queue(_review(spark, sf_dir), cluster=5, label_filter="uncorrected")


@register("highlight_matches", f"""
WITH p AS ({POSTS_SQL})
SELECT tweet_id, regexp_replace(content, '(?i)(\\Qthe\\E)', '<mark>\\1</mark>', 'g') AS content FROM p
""")
def highlight_matches(spark, sf_dir):
    p = posts_from_documents(spark, sf_dir)
    return p.select("tweet_id", L.highlight(F.col("content"), "the").alias("content"))


@register("review_export", f"""
WITH {_REVIEW_SQL}
SELECT id, cluster, probability, content, relevant, relevant AS original_label, 'uncorrected' AS status,
       pred, author, 0 AS comment_count, 0 AS repost_count, 0 AS like_count, 0 AS view_count,
       CAST(id AS VARCHAR) AS tweet_id
FROM rv
""")
def review_export(spark, sf_dir):
    return L.review_export_flat(_review(spark, sf_dir).drop("status"), "relevant")


@register("review_export_stats", f"""
WITH {_SENT_SQL},
sz AS (SELECT cluster, count(*) AS size FROM sv GROUP BY cluster),
lb AS (SELECT cluster, sentiment, count(*) AS cnt FROM sv WHERE sentiment <> -1 GROUP BY ALL)
SELECT sz.cluster AS cluster_id, sz.size, lb.sentiment AS label, lb.cnt
FROM sz LEFT JOIN lb USING (cluster)
""")
def review_export_stats(spark, sf_dir):
    return L.review_export_stats(_sentiment(spark, sf_dir), "cluster", "sentiment")


@register("review_export_nested")
def review_export_nested(spark, sf_dir):
    return L.review_export_nested(_sentiment(spark, sf_dir), "cluster", "sentiment", "tweet_id")


@register("review_export_blocks", f"""
WITH {_SENT_SQL},
r AS (SELECT cluster, tweet_id, row_number() OVER (PARTITION BY cluster
             ORDER BY ('0x' || substr(md5('42:' || CAST(tweet_id AS VARCHAR)), 1, 15))::BIGINT, tweet_id) - 1 AS k FROM sv)
SELECT cluster AS cluster_id, CAST(k // 20 AS BIGINT) AS chunk, (SELECT count(*) FROM sv WHERE sv.cluster = r.cluster) AS size,
       list(CAST(tweet_id AS VARCHAR) ORDER BY k) AS ids
FROM r GROUP BY r.cluster, k // 20
""")
def review_export_blocks(spark, sf_dir):
    """The blocks of the nested export (twenty samples each here) and their samples in order."""
    nested = L.review_export_nested(_sentiment(spark, sf_dir), "cluster", "sentiment", "tweet_id", chunk=20)
    return nested.select("cluster_id", "chunk", F.col("stats.size").alias("size"), F.transform("samples", lambda x: x["tweet_id"]).alias("ids"))


@register("review_metadata", f"""
WITH {_SENT_SQL}
SELECT 1 AS version, count(DISTINCT cluster) AS num_clusters, count(*) AS num_samples FROM sv
""")
def review_metadata(spark, sf_dir):
    """The export's metadata record (without its generation time)."""
    return L.review_metadata(_sentiment(spark, sf_dir)).drop("generated_at")


@register("review_flatten", f"""
WITH {_SENT_SQL},
c AS (SELECT cluster, sentiment, count(*) AS n FROM sv WHERE sentiment <> -1 GROUP BY ALL),
d AS (SELECT cluster, sentiment AS dominant FROM (
        SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, sentiment ASC) AS rn FROM c) WHERE rn = 1)
SELECT sv.cluster AS cluster_id, CAST(sv.tweet_id AS VARCHAR) AS tweet_id, sv.content, sv.author,
       CAST(NULL AS VARCHAR) AS time, sv.probability AS cluster_probability, sv.sentiment AS original_label,
       sv.sentiment AS current_label, sv.sentiment = -1 AS is_unlabeled,
       coalesce(sv.sentiment <> -1 AND d.dominant IS NOT NULL AND sv.sentiment <> d.dominant, FALSE) AS needs_check
FROM sv LEFT JOIN d USING (cluster)
""")
def review_flatten(spark, sf_dir):
    nested = L.review_export_nested(_sentiment(spark, sf_dir), "cluster", "sentiment", "tweet_id")
    return L.flatten_review(nested)
