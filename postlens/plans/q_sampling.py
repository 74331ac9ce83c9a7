"""Catalogue: de-duplication, exact and stratified splits, samplers, set operations, leakage and
anti-join exclusion (G1–G8, D5, D6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from postlens.operators import labels as L
from postlens.operators import sampling as S
from postlens.plans.registry import register
from postlens.sources.tables import POSTS_SQL, posts_from_documents, table

SEED = 42


def _key_sql(col: str, seed: int = SEED) -> str:
    return f"('0x' || substr(md5('{seed}:' || CAST({col} AS VARCHAR)), 1, 15))::BIGINT"


@register("dedup_content", f"""
WITH p AS ({POSTS_SQL})
SELECT tweet_id, content, author, lang FROM (
  SELECT *, row_number() OVER (PARTITION BY content ORDER BY tweet_id) AS rn FROM p)
WHERE rn = 1
""")
def dedup_content(spark, sf_dir):
    return S.dedup_first(posts_from_documents(spark, sf_dir), "content", "tweet_id")


@register("split_exact", f"""
WITH k AS (SELECT doc_id, {_key_sql('doc_id')} AS key FROM documents),
r AS (SELECT doc_id, row_number() OVER (ORDER BY key, doc_id) AS rank, count(*) OVER () AS n FROM k)
SELECT doc_id, CASE WHEN rank <= ceil(n * 0.2 - 1e-9) THEN 'test' ELSE 'train' END AS split FROM r
""")
def split_exact(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return S.split_exact(docs, "doc_id", test=0.2, seed=SEED)


_STRAT_SQL = f"""
k AS (SELECT doc_id, quality, {_key_sql('doc_id')} AS key FROM labels),
r AS (SELECT doc_id, quality,
             row_number() OVER (PARTITION BY quality ORDER BY key, doc_id) AS rank,
             count(*) OVER (PARTITION BY quality) AS n FROM k),
sp AS (SELECT doc_id, quality, CASE WHEN rank <= round(n * 0.25) THEN 'test' ELSE 'train' END AS split FROM r)
"""


@register("split_stratified", f"WITH {_STRAT_SQL} SELECT doc_id, quality, split FROM sp")
def split_stratified(spark, sf_dir):
    lab = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return S.split_exact(lab, "doc_id", test=0.25, seed=SEED, by=["quality"])


@register("balanced_sample", f"""
WITH sz AS (SELECT label, count(*) AS size FROM embeddings GROUP BY label),
q AS (SELECT label, size, row_number() OVER (ORDER BY label) - 1 AS i, count(*) OVER () AS k,
             sum(size) OVER () AS total FROM sz),
q2 AS (SELECT label, CAST(least(floor(least(125, total) / k)
                           + CASE WHEN i < least(125, total) % k THEN 1 ELSE 0 END, size) AS BIGINT) AS quota
       FROM q),
r AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY {_key_sql('vec_id')}, vec_id) AS rank
      FROM embeddings)
SELECT r.vec_id, r.label, r.rank FROM r JOIN q2 USING (label) WHERE r.rank <= q2.quota
""")
def balanced_sample(spark, sf_dir):
    emb = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    return S.balanced_sample(emb, "vec_id", "label", n=125, seed=SEED)


def _prob(spark, sf_dir):
    emb = table(spark, sf_dir, "embeddings")
    a = F.abs(F.col("embedding")[0].cast("double"))
    b = F.abs(F.col("embedding")[1].cast("double"))
    return emb.select("vec_id", F.col("label").alias("cluster"), (a / (a + b)).alias("probability"))


_PROB_SQL = """
e AS (SELECT vec_id, label AS cluster,
             abs(CAST(embedding[1] AS DOUBLE)) / (abs(CAST(embedding[1] AS DOUBLE)) + abs(CAST(embedding[2] AS DOUBLE))) AS probability
      FROM embeddings)"""

_FILTER_SQL = {"above_mean": "probability > mu", "below_mean": "probability <= mu",
               "above_mean_std": "probability > mu - sd", "none": "TRUE"}
_WEIGHT_SQL = {"uniform": "1.0", "inverse_prob": "(1.0 / (probability + 1e-6))",
               "mild_inverse_prob": "((1.0 - probability) + 1e-5)", "confidence_prob": "probability"}


def _ablation_sql(n, filter_mode, budget, bias):
    b = (f"ceil({float(n)} / k)" if budget == "equal"
         else f"round_even(CAST(size AS DOUBLE) / total * {float(n)}, 0)")
    return f"""
WITH {_PROB_SQL},
x AS (SELECT * FROM e WHERE cluster <> -1),
st AS (SELECT cluster, avg(probability) AS mu, stddev_pop(probability) AS sd FROM x GROUP BY cluster),
f AS (SELECT x.* FROM x JOIN st USING (cluster) WHERE {_FILTER_SQL[filter_mode]}),
sz AS (SELECT cluster, count(*) AS size FROM f GROUP BY cluster),
sz2 AS (SELECT cluster, size, count(*) OVER () AS k, sum(size) OVER () AS total FROM sz),
bu AS (SELECT cluster, CAST(greatest(least({b}, size), 1) AS BIGINT) AS budget FROM sz2),
w AS (SELECT f.*, {_key_sql('vec_id')} AS key FROM f),
es AS (SELECT *, -ln((CAST(key AS DOUBLE) + 0.5) / 1152921504606846976.0) / {_WEIGHT_SQL[bias]} AS es FROM w),
r AS (SELECT es.vec_id, es.cluster, es.probability, bu.budget,
             row_number() OVER (PARTITION BY es.cluster ORDER BY es.es, es.key, es.vec_id) AS rank
      FROM es JOIN bu USING (cluster))
SELECT vec_id, cluster, probability, rank FROM r WHERE rank <= budget
"""


def _ablation(name, n, filter_mode, budget, bias):
    def q(spark, sf_dir):
        return S.ablation_sample(_prob(spark, sf_dir), "vec_id", "cluster", "probability", n,
                                 seed=SEED, filter_mode=filter_mode, budget=budget, bias=bias)
    register(name, _ablation_sql(n, filter_mode, budget, bias))(q)


_ablation("ablation_sample_default", 150, "above_mean_std", "direct_proportion", "uniform")
_ablation("ablation_sample_inverse", 100, "above_mean", "equal", "inverse_prob")
_ablation("ablation_sample_mild", 80, "below_mean", "direct_proportion", "mild_inverse_prob")
_ablation("ablation_sample_confidence", 60, "none", "equal", "confidence_prob")


def _labelled_splits(spark, sf_dir):
    """Labelled posts split 75/25 by hash rank (the train and test sets of the catalogue)."""
    lab = table(spark, sf_dir, "labels").select("doc_id")
    sp = S.split_exact(lab, "doc_id", test=0.25, seed=SEED)
    sp = sp.join(_raw_posts(spark, sf_dir), sp.doc_id == F.col("tweet_id"), "inner") \
        .select("tweet_id", "content", "split")
    return (sp.where("split = 'train'").drop("split"), sp.where("split = 'test'").drop("split"))


def _raw_posts(spark, sf_dir):
    """Posts with the raw document text (which holds exact copies, unlike the decorated view)."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("tweet_id"), F.col("text").alias("content"))


_LSPLIT_SQL = f"""
p AS (SELECT doc_id AS tweet_id, text AS content FROM documents),
lk AS (SELECT doc_id, {_key_sql('doc_id')} AS key FROM labels),
lr AS (SELECT doc_id, row_number() OVER (ORDER BY key, doc_id) AS rank, count(*) OVER () AS n FROM lk),
ls AS (SELECT doc_id, CASE WHEN rank <= ceil(n * 0.25 - 1e-9) THEN 'test' ELSE 'train' END AS split FROM lr),
sp AS (SELECT p.tweet_id, p.content, ls.split FROM ls JOIN p ON ls.doc_id = p.tweet_id),
train AS (SELECT tweet_id, content FROM sp WHERE split = 'train'),
test AS (SELECT tweet_id, content FROM sp WHERE split = 'test')
"""


@register("leakage_report", f"""
WITH {_LSPLIT_SQL},
ov AS (SELECT DISTINCT content FROM train WHERE content IN (SELECT content FROM test))
SELECT (SELECT count(*) FROM ov) AS overlap_count, (SELECT count(*) FROM train) AS train_rows,
       (SELECT count(*) FROM ov) * 100.0 / (SELECT count(*) FROM train) AS overlap_pct
""")
def leakage_report(spark, sf_dir):
    train, test = _labelled_splits(spark, sf_dir)
    return L.leakage_report(train, test, "content")


@register("leakage_overlap", f"""
WITH {_LSPLIT_SQL}
SELECT DISTINCT content FROM train WHERE content IN (SELECT content FROM test)
""")
def leakage_overlap(spark, sf_dir):
    train, test = _labelled_splits(spark, sf_dir)
    return L.overlap_values(train, test, "content")


@register("anti_exclude", f"""
WITH {_LSPLIT_SQL}
SELECT tweet_id, content FROM p
WHERE content NOT IN (SELECT content FROM train) AND content NOT IN (SELECT content FROM test)
""")
def anti_exclude(spark, sf_dir):
    train, test = _labelled_splits(spark, sf_dir)
    return L.exclude_seen(_raw_posts(spark, sf_dir), [train, test], "content")


@register("id_set_ops", f"""
WITH {_LSPLIT_SQL},
a AS (SELECT DISTINCT tweet_id AS doc_id FROM train),
b AS (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1)
SELECT doc_id, 'both' AS part FROM a WHERE doc_id IN (SELECT doc_id FROM b)
UNION ALL SELECT doc_id, 'only_a' FROM a WHERE doc_id NOT IN (SELECT doc_id FROM b)
UNION ALL SELECT doc_id, 'only_b' FROM b WHERE doc_id NOT IN (SELECT doc_id FROM a)
""")
def id_set_ops(spark, sf_dir):
    train, _ = _labelled_splits(spark, sf_dir)
    a = train.select(F.col("tweet_id").alias("doc_id"))
    b = table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id")
    both, only_a, only_b = S.id_overlap(a, b, "doc_id")
    return (both.withColumn("part", F.lit("both"))
            .unionByName(only_a.withColumn("part", F.lit("only_a")))
            .unionByName(only_b.withColumn("part", F.lit("only_b"))))


@register("dedup_ids", """
SELECT tweet_id, time, content FROM (
  SELECT concat(CAST(user_id AS VARCHAR), '-', event_type) AS tweet_id, ts AS time, CAST(event_id AS VARCHAR) AS content,
         row_number() OVER (PARTITION BY concat(CAST(user_id AS VARCHAR), '-', event_type)
                            ORDER BY ts, CAST(event_id AS VARCHAR)) AS rn
  FROM events) WHERE rn = 1
""")
def dedup_ids(spark, sf_dir):
    """One row per post id (the first by time) in a feed with repeated ids."""
    ev = table(spark, sf_dir, "events")
    feed = ev.select(F.concat(F.col("user_id").cast("string"), F.lit("-"), F.col("event_type")).alias("tweet_id"),
                     F.col("ts").alias("time"), F.col("event_id").cast("string").alias("content"))
    return S.dedup_ids(feed, "tweet_id")


@register("concat_splits", f"""
WITH p AS ({POSTS_SQL}),
k AS (SELECT tweet_id, content, author, {_key_sql('tweet_id')} AS key FROM p),
r AS (SELECT *, row_number() OVER (ORDER BY key, tweet_id) AS rank, count(*) OVER () AS n FROM k)
SELECT tweet_id, content, author, NULL::VARCHAR AS lang, 'a' AS part FROM r WHERE rank <= ceil(n * 0.5 - 1e-9)
UNION ALL
SELECT p.tweet_id, p.content, NULL AS author, p.lang, 'b' AS part FROM p JOIN r USING (tweet_id)
WHERE r.rank > ceil(r.n * 0.5 - 1e-9)
""")
def concat_splits(spark, sf_dir):
    """Two halves with different columns appended by name (missing columns NULL)."""
    posts = posts_from_documents(spark, sf_dir)
    sp = S.split_exact(posts, "tweet_id", test=0.5, seed=SEED)
    a = sp.where("split = 'test'").select("tweet_id", "content", "author").withColumn("part", F.lit("a"))
    b = sp.where("split = 'train'").select("tweet_id", "content", "lang").withColumn("part", F.lit("b"))
    return S.concat(a, b)
