"""Catalogue: text cleaning steps, stop words, hashtags and keyword tables over the ``posts`` view."""

from __future__ import annotations

from pyspark.sql import functions as F

from postlens.functions import text as T
from postlens.functions.stopwords import DEFAULT_STOPWORDS, sql_list
from postlens.operators import keywords as K
from postlens.plans.registry import register
from postlens.session import checkpoint_dir
from postlens.sources.tables import POSTS_SQL, posts_from_documents

_P = f"WITH p AS ({POSTS_SQL})"
_WC = r"[\p{L}\p{N}_]"
_STOP = sql_list(DEFAULT_STOPWORDS)


def _posts(spark, sf_dir):
    return posts_from_documents(spark, sf_dir)


@register("clean_url", _P + r"""
SELECT tweet_id, regexp_replace(content, 'https?://\S+', ' <url> ', 'g') AS content FROM p
""")
def clean_url(spark, sf_dir):
    return _posts(spark, sf_dir).select("tweet_id", T.url_token("content").alias("content"))


@register("clean_mention", _P + r"""
SELECT tweet_id, regexp_replace(content, '@[\p{L}\p{N}_]+', '@USER', 'g') AS content FROM p
""")
def clean_mention(spark, sf_dir):
    return _posts(spark, sf_dir).select("tweet_id", T.mention_token("content").alias("content"))


@register("clean_rt_year_cut", _P + r"""
SELECT tweet_id,
       regexp_replace(
         regexp_replace(
           regexp_replace(content, '(?i)^rt\s+', ''),
           '(^|[^\p{L}\p{N}_])([0-9]{4})([a-zA-Z])', '\1\2 \3', 'g'),
         '(?is)kutipan.*$', '') AS content
FROM p
""")
def clean_rt_year_cut(spark, sf_dir):
    c = T.quote_cut(T.year_split(T.rt_prefix("content")))
    return _posts(spark, sf_dir).select("tweet_id", c.alias("content"))


@register("clean_dari_domain", _P + r"""
SELECT tweet_id,
       regexp_replace(
         regexp_replace(
           regexp_replace(
             regexp_replace(content, '(?i)(\S+)dari\s+([a-z0-9.-]+\.[a-z]{2,})\b', '\1', 'g'),
             '(?i)\s+dari\s+([a-z0-9.-]+\.[a-z]{2,})\b', '', 'g'),
           '(?i)(\S+)dari\b', '\1', 'g'),
         '(?i)\b[a-z0-9.-]+\.[a-z]{2,}\b', ' ', 'g') AS content
FROM p
""")
def clean_dari_domain(spark, sf_dir):
    return _posts(spark, sf_dir).select("tweet_id", T.dari_domain("content").alias("content"))


@register("clean_post_full")
def clean_post_full(spark, sf_dir):
    """C1 in full (NFKC and emoji names need Python, so no SQL oracle)."""
    return _posts(spark, sf_dir).select("tweet_id", T.clean_post("content").alias("content"))


@register("clean_dataset_text")
def clean_dataset_text(spark, sf_dir):
    return _posts(spark, sf_dir).select("tweet_id", T.clean_dataset("content").alias("content"))


@register("clean_for_embedding")
def clean_for_embedding(spark, sf_dir):
    return _posts(spark, sf_dir).select("tweet_id", T.clean_for_embedding("content").alias("content"))


@register("hashtags_removed", _P + r"""
SELECT tweet_id,
       trim(regexp_replace(
         regexp_replace(content, '(^|[^\p{L}\p{N}_])#[\p{L}\p{N}_]+', '\1', 'g'),
         '\s+', ' ', 'g')) AS content
FROM p
""")
def hashtags_removed(spark, sf_dir):
    return _posts(spark, sf_dir).select("tweet_id", T.remove_hashtags("content").alias("content"))


@register("stopword_removed", _P + f"""
SELECT tweet_id,
       array_to_string(list_filter(regexp_split_to_array(content, '\\s+'),
                                   lambda w: w <> '' AND lower(w) NOT IN ({_STOP})), ' ') AS content
FROM p
""")
def stopword_removed(spark, sf_dir):
    return _posts(spark, sf_dir).select(
        "tweet_id", T.remove_stopwords("content", DEFAULT_STOPWORDS).alias("content"))


@register("avg_word_length", _P + r"""
, w AS (SELECT tweet_id, list_filter(regexp_split_to_array(content, '\s+'), lambda x: x <> '') AS words FROM p)
SELECT tweet_id, list_sum(list_transform(words, lambda x: length(x))) / len(words) AS avg_word_len
FROM w WHERE len(words) > 0
  AND list_sum(list_transform(words, lambda x: length(x))) / len(words) >= 2.5
""")
def avg_word_length(spark, sf_dir):
    words = _posts(spark, sf_dir).select("tweet_id", T.split_ws(F.col("content")).alias("_w"))
    out = words.select("tweet_id", T.avg_word_length(F.col("_w")).alias("avg_word_len"))
    return out.where(F.col("avg_word_len") >= 2.5)


@register("top_hashtags", _P + r"""
, t AS (SELECT unnest(regexp_extract_all(lower(content), '#[\p{L}\p{N}_]+')) AS token FROM p)
SELECT token, count(*) AS cnt FROM t GROUP BY token ORDER BY cnt DESC, token ASC LIMIT 100
""")
def top_hashtags(spark, sf_dir):
    return K.top_hashtags(_posts(spark, sf_dir), n=100)


_NGRAMS_SQL = _P + f"""
, tk AS (
  SELECT list_filter(regexp_extract_all(lower(content), '#{_WC}+|{_WC}{{2,}}'),
                     lambda w: w NOT IN ({_STOP})) AS t
  FROM p),
ns AS (SELECT unnest(range(1, 6)) AS n),
g AS (
  SELECT array_to_string(t[i + 1 : i + n], ' ') AS token
  FROM tk CROSS JOIN ns, LATERAL (SELECT unnest(range(0, len(t) - n + 1)) AS i)),
top AS (SELECT token, count(*) AS cnt FROM g GROUP BY token ORDER BY cnt DESC, token ASC LIMIT 200)
"""


@register("top_ngrams", _NGRAMS_SQL + "SELECT token, cnt FROM top")
def top_ngrams(spark, sf_dir):
    return K.top_ngrams(_posts(spark, sf_dir), n=200)


@register("reaggregate_tags", _NGRAMS_SQL + r"""
, tg AS (SELECT token, cnt, regexp_extract_all(token, '#[\p{L}\p{N}_]+') AS tags FROM top)
SELECT token, CAST(sum(cnt) AS BIGINT) AS cnt FROM (
  SELECT unnest(CASE WHEN len(tags) = 0 THEN [token] ELSE tags END) AS token, cnt FROM tg)
GROUP BY token
""")
def reaggregate_tags(spark, sf_dir):
    return K.reaggregate_hashtags(K.top_ngrams(_posts(spark, sf_dir), n=200))


@register("term_cloud", _P + f"""
, c AS (
  SELECT trim(regexp_replace(
           regexp_replace(content, '(^|[^\\p{{L}}\\p{{N}}_])#[\\p{{L}}\\p{{N}}_]+', '\\1', 'g'),
           '\\s+', ' ', 'g')) AS content
  FROM p),
s AS (
  SELECT list_filter(regexp_split_to_array(content, '\\s+'),
                     lambda w: w <> '' AND lower(w) NOT IN ({_STOP})) AS words
  FROM c)
SELECT token, count(*) AS cnt FROM (SELECT lower(unnest(words)) AS token FROM s)
GROUP BY token ORDER BY cnt DESC, token ASC LIMIT 1000
""")
def term_cloud(spark, sf_dir):
    return K.term_frequencies(_posts(spark, sf_dir), n=1000)


@register("term_cloud_by_lang", _P + f"""
, c AS (
  SELECT lang, trim(regexp_replace(
           regexp_replace(content, '(^|[^\\p{{L}}\\p{{N}}_])#[\\p{{L}}\\p{{N}}_]+', '\\1', 'g'),
           '\\s+', ' ', 'g')) AS content
  FROM p),
s AS (
  SELECT lang, list_filter(regexp_split_to_array(content, '\\s+'),
                     lambda w: w <> '' AND lower(w) NOT IN ({_STOP})) AS words
  FROM c),
cnt AS (SELECT lang, token, count(*) AS cnt FROM (SELECT lang, lower(unnest(words)) AS token FROM s)
        GROUP BY lang, token)
SELECT * FROM (
  SELECT lang, token, cnt, row_number() OVER (PARTITION BY lang ORDER BY cnt DESC, token ASC) AS rank
  FROM cnt) WHERE rank <= 50
""")
def term_cloud_by_lang(spark, sf_dir):
    return K.term_frequencies(_posts(spark, sf_dir), n=50, by="lang")


@register("squeeze_repeats", _P + """
, ch AS (SELECT tweet_id, unnest(string_split(content, '')) AS c, generate_subscripts(string_split(content, ''), 1) AS i FROM p),
g AS (SELECT *, i - row_number() OVER (PARTITION BY tweet_id, c ORDER BY i) AS g FROM ch),
r AS (SELECT tweet_id, c, min(i) AS i, count(*) AS n FROM g GROUP BY tweet_id, c, g)
SELECT tweet_id, string_agg(CASE WHEN n >= 3 AND c <> chr(10) THEN c ELSE repeat(c, n) END, '' ORDER BY i) AS content
FROM r GROUP BY tweet_id
""")
def squeeze_repeats(spark, sf_dir):
    """Three or more of the same character become one."""
    return _posts(spark, sf_dir).select("tweet_id", T.squeeze_repeats("content").alias("content"))


@register("nfkc_emoji")
def nfkc_emoji(spark, sf_dir):
    """Unicode NFKC (full-width folding) and emoji names, the two Python-side steps."""
    from postlens.functions.unicode import demojize, nfkc
    return _posts(spark, sf_dir).select("tweet_id", demojize(nfkc(F.col("content"))).alias("content"))


def _keywords(posts):
    """Every hashtag of every text: segmented (C17), average word length of at least 2.5 (C19), language
    (C18)."""
    from postlens.operators import classify as C
    checkpoint_dir(posts.sparkSession)
    tags = K.top_hashtags(posts, n=None).select(F.expr("substring(token, 2)").alias("token"), "cnt").checkpoint()
    split = C.segment_column(tags, "token", C.unigram_counts(posts, "content"), "keyword")
    long = split.where(T.avg_word_length(T.split_ws(F.col("keyword"))) >= 2.5)
    return C.guess_language(long, "keyword").where(F.col("guess").isin("id", "en", "unknown"))


@register("keyword_candidates")
def keyword_candidates(spark, sf_dir):
    """The keyword filter chain: all hashtags, as words → distinct candidates with their counts."""
    return _keywords(_posts(spark, sf_dir)).groupBy("keyword", "guess").agg(F.sum("cnt").cast("long").alias("cnt"))


@register("keyword_ranking")
def keyword_ranking(spark, sf_dir):
    """All candidates of the chain by the cosine of their learned vector to the mean
    of the posts' vectors."""
    from postlens.operators import embeddings as EM
    posts = _posts(spark, sf_dir).select("tweet_id", "content")
    model = EM.learn_word_vectors(posts, "content")
    words = _keywords(posts).groupBy("keyword").agg(F.sum("cnt").cast("long").alias("cnt"))
    return EM.rank_keywords(words, "keyword", posts, "content", model)


@register("embed_learned")
def embed_learned(spark, sf_dir):
    """H1: vectors of all posts from word vectors learned on them."""
    from postlens.operators import embeddings as EM
    posts = _posts(spark, sf_dir).select("tweet_id", "content")
    return EM.embed_texts(posts, "content", EM.learn_word_vectors(posts, "content")).select("tweet_id", "embedding")
