"""Catalogue: token ids, language guess, segmentation, classifier training and scoring, and a
self-training round, over the ``posts`` view and ``labels``."""

from __future__ import annotations

from pyspark.sql import functions as F

from postlens.operators import classify as C
from postlens.operators import evaluate as E
from postlens.operators import keywords as K
from postlens.operators import sampling as S
from postlens.operators import language as LG
from postlens.operators.sampling import hash_key
from postlens.plans.registry import register
from postlens.session import checkpoint_dir
from postlens.sources.tables import POSTS_SQL, posts_from_documents, table

MAX_LEN = 128
_TOK = r"#[\p{L}\p{N}_]+|[\p{L}\p{N}_]{2,}"


@register("encode_tokens", f"""
WITH p AS ({POSTS_SQL}),
tk AS (SELECT tweet_id, regexp_extract_all(lower(content), '{_TOK}') AS toks FROM p),
t AS (SELECT tweet_id, unnest(toks) AS token, generate_subscripts(toks, 1) - 1 AS pos FROM tk),
vocab AS (SELECT token, row_number() OVER (ORDER BY cnt DESC, token ASC) + 1 AS token_id
          FROM (SELECT token, count(*) AS cnt FROM t GROUP BY token)),
ids AS (SELECT t.tweet_id, t.pos, coalesce(v.token_id, 1) AS tid FROM t LEFT JOIN vocab v USING (token)
        WHERE t.pos < {MAX_LEN}),
seq AS (SELECT p.tweet_id, coalesce(list(ids.tid ORDER BY ids.pos) FILTER (WHERE ids.tid IS NOT NULL), []) AS r
        FROM p LEFT JOIN ids USING (tweet_id) GROUP BY p.tweet_id)
SELECT tweet_id, list_concat(r, list_transform(range({MAX_LEN} - len(r)), lambda i: 0)) AS input_ids,
       list_concat(list_transform(r, lambda x: 1), list_transform(range({MAX_LEN} - len(r)), lambda i: 0))
         AS attention_mask
FROM seq
""")
def encode_tokens(spark, sf_dir):
    posts = posts_from_documents(spark, sf_dir)
    vocab = C.build_vocabulary(posts, "content")
    return C.encode_tokens(posts, "tweet_id", "content", vocab, MAX_LEN)


def _lang_sql():
    cnt = {l: f"len(list_filter(w, lambda x: x IN ({', '.join(repr(v) for v in ws)})))"
           for l, ws in C.LANG_PROFILES.items()}
    top = "greatest(" + ", ".join(cnt.values()) + ")"
    case = " ".join(f"WHEN {c} = {top} THEN '{l}'" for l, c in cnt.items())
    return f"""
WITH d AS (SELECT doc_id, lang, regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}_'']+') AS w FROM documents)
SELECT doc_id, lang, CASE WHEN {top} > 0 THEN (CASE {case} END) ELSE 'unknown' END AS guess FROM d
"""


@register("lang_guess", _lang_sql())
def lang_guess(spark, sf_dir):
    return C.guess_language(table(spark, sf_dir, "documents"), "text").select("doc_id", "lang", "guess")


_GRAM_HELD = "('0x' || substr(md5('42:' || CAST(doc_id AS VARCHAR)), 1, 15))::BIGINT % 5 = 0"

_LANG_GRAMS_SQL = f"""
WITH d AS (SELECT doc_id, lang, regexp_extract_all(lower(coalesce(text, '')), '\\p{{L}}+') AS w, {_GRAM_HELD} AS held_out,
                  text IS NOT NULL AND lang IS NOT NULL AS labelled FROM documents),
w AS (SELECT doc_id, lang, held_out, labelled, unnest(w) AS word FROM d),
train AS (SELECT lang, word, count(*) AS n FROM w WHERE labelled AND NOT held_out GROUP BY ALL),
words AS (SELECT DISTINCT '_' || word || '_' AS p, word FROM w),
grams AS (SELECT word, substr(p, i, k) AS gram FROM (SELECT word, p, k, unnest(range(1, length(p) - k + 2)) AS i
          FROM words, (SELECT unnest([1, 2, 3]) AS k)) WHERE substr(p, i, k) <> '_'),
c AS (SELECT lang, gram, sum(n) AS n FROM train JOIN grams USING (word) GROUP BY ALL),
kept AS (SELECT gram FROM c GROUP BY gram ORDER BY sum(n) DESC, gram LIMIT 200000),
t AS (SELECT lang, sum(n) AS n FROM c JOIN kept USING (gram) GROUP BY lang),
l AS (SELECT lang, ln(count(*) / (SELECT count(*) FROM d WHERE labelled AND NOT held_out)) AS prior FROM d WHERE labelled AND NOT held_out GROUP BY lang),
s AS (SELECT kept.gram, l.lang, ln(coalesce(c.n, 0) + 1) - ln(t.n + (SELECT count(*) FROM kept)) AS score
      FROM kept CROSS JOIN l JOIN t USING (lang) LEFT JOIN c ON c.lang = l.lang AND c.gram = kept.gram),
ws AS (SELECT word, lang, sum(score) AS score FROM grams JOIN s USING (gram) GROUP BY ALL),
ds AS (SELECT doc_id, ws.lang, sum(score) AS score FROM w JOIN ws USING (word) GROUP BY ALL),
best AS (SELECT doc_id, arg_max(lang, score + prior) AS guess FROM ds JOIN l USING (lang) GROUP BY doc_id)
SELECT doc_id, lang, held_out, coalesce(guess, 'unknown') AS guess FROM d LEFT JOIN best USING (doc_id)
"""


@register("lang_ngrams", _LANG_GRAMS_SQL)
def lang_ngrams(spark, sf_dir):
    """Learned from four fifths of the labelled documents, said of all."""
    held = hash_key("doc_id") % 5 == 0
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text", held.alias("held_out"))
    model = LG.train_language_model(docs.where("not held_out"), "text", "lang")
    return LG.guess_language_ngrams(docs, "text", model).select("doc_id", "lang", "held_out", "guess")


@register("lang_filter", f"SELECT doc_id, guess FROM ({_lang_sql()}) WHERE guess IN ('id', 'en')")
def lang_filter(spark, sf_dir):
    d = C.guess_language(table(spark, sf_dir, "documents"), "text")
    return d.select("doc_id", "guess").where(F.col("guess").isin("id", "en"))


@register("segment_tokens")
def segment_tokens(spark, sf_dir):
    """C17: glued word pairs of the corpus split back into dictionary words."""
    posts = posts_from_documents(spark, sf_dir)
    counts = C.unigram_counts(posts, "content")
    glued = posts.select("tweet_id", F.regexp_replace(F.lower(F.col("content")),
                                                      r"(\p{L}+) (\p{L}+)", "$1$2").alias("glued"))
    return C.segment_column(glued, "glued", counts)


@register("segment_pairs")
def segment_pairs(spark, sf_dir):
    """C17 with word pairs: the glued hashtags of all posts, split by words and their predecessors."""
    posts = posts_from_documents(spark, sf_dir)
    tags = K.top_hashtags(posts, n=None).select(F.expr("substring(token, 2)").alias("tag"), "cnt")
    return C.segment_column(tags, "tag", C.unigram_counts(posts, "content"), pairs=C.pair_counts(posts, "content"))


@register("reaggregate_segmented")
def reaggregate_segmented(spark, sf_dir):
    posts = posts_from_documents(spark, sf_dir)
    return C.reaggregate_segmented(K.top_ngrams(posts, n=200), C.unigram_counts(posts, "content"), 50)


def _labelled(spark, sf_dir):
    posts = posts_from_documents(spark, sf_dir)
    lab = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("tweet_id"), F.col("quality").alias("label"))
    return posts.join(lab, "tweet_id")


@register("text_classifier")
def text_classifier(spark, sf_dir):
    """Model selection table (macro F1 and accuracy per regularisation)."""
    data = S.split_exact(_labelled(spark, sf_dir), "tweet_id", test=0.2).where("split = 'train'")
    _, table_ = C.train_classifier(data, "content", "label", "tweet_id", (0, 1), "binary")
    return table_


@register("batch_score")
def batch_score(spark, sf_dir):
    """Train on the 80 % split, score the held-out 20 %."""
    parts = S.split_exact(_labelled(spark, sf_dir), "tweet_id", test=0.2)
    model, _ = C.train_classifier(parts.where("split = 'train'"), "content", "label", "tweet_id", (0, 1),
                                  "binary", regs=(0.01,))
    scored = C.score(model, parts.where("split = 'test'"), 2)
    return scored.select("tweet_id", "label", "pred", "confidence", "prob_0", "prob_1")


@register("batch_score_counts")
def batch_score_counts(spark, sf_dir):
    """How many held-out posts got each class, and how sure the model is on average."""
    return batch_score(spark, sf_dir).groupBy("pred").agg(F.count(F.lit(1)).alias("cnt"), F.avg("confidence").alias("confidence"))


def _sentiment(spark, sf_dir):
    lab = table(spark, sf_dir, "labels")
    sent = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 1, 2).otherwise(1)
    return posts_from_documents(spark, sf_dir).join(lab.select(F.col("doc_id").alias("tweet_id"), sent.alias("label")), "tweet_id")


@register("sentiment_classifier")
def sentiment_classifier(spark, sf_dir):
    """Three classes with focal weighting; precision, recall and F1 per class on held-out posts."""
    parts = S.split_exact(_sentiment(spark, sf_dir), "tweet_id", test=0.2)
    model = C.train_focal(parts.where("split = 'train'"), "content", "label", (0, 1, 2))
    return E.per_class_metrics(C.score(model, parts.where("split = 'test'"), 3).select("label", "pred"), (0, 1, 2),
                               names=("Negative", "Neutral", "Positive"))


@register("relevance_metrics")
def relevance_metrics(spark, sf_dir):
    """The binary model's precision, recall and F1 per class on held-out posts."""
    return E.per_class_metrics(batch_score(spark, sf_dir), (0, 1), names=("Irrelevant", "Relevant"))


@register("self_training")
def self_training(spark, sf_dir):
    """One expansion round on the 75/25 labelled split with the study's 50 000 unlabelled posts (all
    where the pool is smaller)."""
    posts = posts_from_documents(spark, sf_dir)
    lab = table(spark, sf_dir, "labels")
    sent = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 1, 2).otherwise(1)
    labelled = posts.join(lab.select(F.col("doc_id").alias("tweet_id"), sent.alias("sentiment")), "tweet_id")
    checkpoint_dir(spark)
    parts = S.split_exact(labelled.select("tweet_id", "content", "sentiment"), "tweet_id", test=0.25).checkpoint()
    train = parts.where("split = 'train'").drop("split")
    test = parts.where("split = 'test'").drop("split")
    return C.self_training_round(posts, train, test, 50_000)
