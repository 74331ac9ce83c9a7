"""Catalogue: ingest, parsers, search, crawl state and rule labels.

Inputs built from the driver's tables in both engines: engagement strings and K/M counts from
``lineitem`` numbers, ISO time strings from ``orders``, raw v1 items from ``conversations``,
labeller responses from ``labels`` ⋈ ``documents``, crawl runs = days of ``events``.
"""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from postlens.functions import parse as PA
from postlens.functions import text as TX
from postlens.operators import crawl as CR
from postlens.operators import rules as R
from postlens.operators import search as SE
from postlens.plans.registry import register
from postlens.sources import ingest as IN
from postlens.sources.tables import EVENTS_POSTS_SQL, POSTS_SQL, posts_from_documents, posts_from_events, table


def _s(c):
    return c.cast("string")


# ---------------------------------------------------------------- C15: engagement strings

def _engagement_string(li):
    ln = F.col("l_linenumber")
    return F.concat(
        _s(F.col("l_quantity").cast("long")), F.lit(","), _s(ln), F.lit(" rb suka, "),
        _s(F.col("l_partkey") % 1000), F.lit(" balasan, "),
        _s(F.col("l_suppkey") % 10), F.lit("."), _s(F.col("l_orderkey") % 10), F.lit(" jt tayangan, "),
        _s(F.col("l_orderkey") % 50), F.lit(" posting ulang"),
        F.when(ln % 3 == 0, F.concat(F.lit(", "), _s(F.col("l_suppkey")), F.lit(" markah"))).otherwise(F.lit("")),
        F.when(ln % 4 == 0, F.lit(", 7 Suka")).otherwise(F.lit("")),
        F.when(ln % 5 == 0, F.lit(", 3 lainnya")).otherwise(F.lit("")))


_ENG_STR_SQL = """
concat(CAST(CAST(l_quantity AS BIGINT) AS VARCHAR), ',', CAST(l_linenumber AS VARCHAR), ' rb suka, ',
       CAST(l_partkey % 1000 AS VARCHAR), ' balasan, ',
       CAST(l_suppkey % 10 AS VARCHAR), '.', CAST(l_orderkey % 10 AS VARCHAR), ' jt tayangan, ',
       CAST(l_orderkey % 50 AS VARCHAR), ' posting ulang',
       CASE WHEN l_linenumber % 3 = 0 THEN concat(', ', CAST(l_suppkey AS VARCHAR), ' markah') ELSE '' END,
       CASE WHEN l_linenumber % 4 = 0 THEN ', 7 Suka' ELSE '' END,
       CASE WHEN l_linenumber % 5 = 0 THEN ', 3 lainnya' ELSE '' END)"""

_ITEM_RE = r"^([0-9.,]+)\s*(rb|jt)?\s*([a-z\s]+?)$"


def _metric_sql(label: str, name: str) -> str:
    hit = f"list_filter(items, lambda i: i.label = '{label}')"
    last = f"{hit}[-1]"
    num = (f"CAST(nullif(regexp_extract(regexp_replace({last}.num, ',', '.'), "
           f"'^([0-9]+\\.?[0-9]*|\\.[0-9]+)', 1), '') AS DOUBLE)")
    mult = f"CASE {last}.unit WHEN 'rb' THEN 1000.0 WHEN 'jt' THEN 1000000.0 ELSE 1.0 END"
    return f"CASE WHEN len({hit}) > 0 THEN CAST(floor({num} * {mult} + 0.5) AS BIGINT) END AS {name}"


@register("parse_metrics", f"""
WITH s AS (SELECT l_orderkey, l_linenumber, lower({_ENG_STR_SQL}) AS s FROM lineitem),
it AS (SELECT l_orderkey, l_linenumber,
              list_transform(string_split(s, ', '), lambda x: {{
                'num': regexp_extract(x, '{_ITEM_RE}', 1),
                'unit': regexp_extract(x, '{_ITEM_RE}', 2),
                'label': trim(regexp_extract(x, '{_ITEM_RE}', 3))}}) AS items
       FROM s)
SELECT l_orderkey, l_linenumber,
       {", ".join(_metric_sql(lab, m) for lab, m in PA.METRIC_LABELS.items())}
FROM it
""")
def parse_metrics(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    # a column first: the scan runs once, not once per metric
    found = li.select("l_orderkey", "l_linenumber", PA.parse_metrics(_engagement_string(li)).alias("m"))
    return found.select("l_orderkey", "l_linenumber", *[F.col(f"m.{k}").alias(k) for k in PA.METRICS])


# ---------------------------------------------------------------- C16: K/M counts

def _km_string():
    ln = F.col("l_linenumber") % 6
    return (F.when(ln == 0, F.concat(_s(F.col("l_partkey")), F.lit(","),
                                     F.lpad(_s(F.col("l_suppkey") % 1000), 3, "0")))
            .when(ln == 1, F.concat(_s(F.col("l_suppkey") % 100), F.lit("."), _s(F.col("l_orderkey") % 10), F.lit("K")))
            .when(ln == 2, F.concat(_s(F.col("l_orderkey") % 9), F.lit("M")))
            .when(ln == 3, F.lit(""))
            .when(ln == 4, F.lit("abc"))
            .otherwise(_s(F.col("l_quantity").cast("long"))))


_KM_P = ("CAST(nullif(regexp_extract(replace(s, ',', ''), "
         "'^\\s*([+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?)', 1), '') AS DOUBLE)")


@register("parse_km", f"""
WITH t AS (
  SELECT l_orderkey, l_linenumber,
         CASE l_linenumber % 6
           WHEN 0 THEN concat(CAST(l_partkey AS VARCHAR), ',', lpad(CAST(l_suppkey % 1000 AS VARCHAR), 3, '0'))
           WHEN 1 THEN concat(CAST(l_suppkey % 100 AS VARCHAR), '.', CAST(l_orderkey % 10 AS VARCHAR), 'K')
           WHEN 2 THEN concat(CAST(l_orderkey % 9 AS VARCHAR), 'M')
           WHEN 3 THEN '' WHEN 4 THEN 'abc'
           ELSE CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) END AS s
  FROM lineitem)
SELECT l_orderkey, l_linenumber, s AS raw,
       CASE WHEN s IS NULL OR s = '' THEN 0.0
            ELSE coalesce(CASE WHEN lower(s) LIKE '%k' THEN floor({_KM_P} * 1000.0)
                               WHEN lower(s) LIKE '%m' THEN floor({_KM_P} * 1000000.0)
                               ELSE {_KM_P} END, 0.0) END AS value
FROM t
""")
def parse_km(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").withColumn("raw", _km_string())
    return li.select("l_orderkey", "l_linenumber", "raw", PA.parse_km("raw").alias("value"))


# ---------------------------------------------------------------- C21, C25

DEFAULT_TS = "2025-01-01 00:00:00"


@register("parse_time_default", f"""
WITH t AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'DATEUNDEFINED'
                                   ELSE strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%gZ') END AS s FROM orders)
SELECT o_orderkey, s AS raw,
       coalesce(try_strptime(s, '%Y-%m-%dT%H:%M:%S.%gZ'), TIMESTAMP '{DEFAULT_TS}') AS time
FROM t
""")
def parse_time_default(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    raw = F.when(F.col("o_orderkey") % 7 == 0, F.lit("DATEUNDEFINED")).otherwise(
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))
    o = o.select("o_orderkey", raw.alias("raw"))
    default = F.lit(DEFAULT_TS).cast("timestamp_ntz")
    return o.withColumn("time", TX.parse_time_or(F.col("raw"), default))


@register("zero_pad", """
SELECT l_orderkey, l_linenumber,
       CASE WHEN length(CAST(l_linenumber AS VARCHAR)) >= 3 THEN CAST(l_linenumber AS VARCHAR)
            ELSE lpad(CAST(l_linenumber AS VARCHAR), 3, '0') END AS pad_line,
       CASE WHEN length(CAST(l_partkey % 2000 AS VARCHAR)) >= 3 THEN CAST(l_partkey % 2000 AS VARCHAR)
            ELSE lpad(CAST(l_partkey % 2000 AS VARCHAR), 3, '0') END AS pad_part
FROM lineitem
""")
def zero_pad(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", "l_linenumber", TX.zero_pad("l_linenumber").alias("pad_line"),
                     TX.zero_pad(F.col("l_partkey") % 2000).alias("pad_part"))


# ---------------------------------------------------------------- C22: labeller responses

def _responses(spark, sf_dir):
    lab = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id")
    k = F.col("doc_id") % 5
    r = (F.when(k == 0, F.concat(F.lit('{"label": '), _s(F.col("quality") + F.col("toxic")),
                                 F.lit(', "reasoning": "'), F.col("lang"), F.lit('"}')))
         .when(k == 1, F.concat(F.lit('```json\n{"label": '), _s(F.col("quality")),
                                F.lit(', "reasoning": "fenced"}\n```')))
         .when(k == 2, F.concat(F.lit('{"label": '), _s(F.col("toxic")), F.lit(', "reasoning": "trunc')))
         .when(k == 3, F.concat(F.lit('{"reasoning": "'), F.col("source"), F.lit('"}')))
         .otherwise(F.lit("")))
    return lab.select("doc_id", r.alias("response"))


@register("parse_label_response", """
WITH r AS (
  SELECT l.doc_id,
         CASE l.doc_id % 5
           WHEN 0 THEN concat('{"label": ', CAST(l.quality + l.toxic AS VARCHAR), ', "reasoning": "', d.lang, '"}')
           WHEN 1 THEN concat('```json' || chr(10) || '{"label": ', CAST(l.quality AS VARCHAR), ', "reasoning": "fenced"}' || chr(10) || '```')
           WHEN 2 THEN concat('{"label": ', CAST(l.toxic AS VARCHAR), ', "reasoning": "trunc')
           WHEN 3 THEN concat('{"reasoning": "', d.source, '"}')
           ELSE '' END AS response
  FROM labels l JOIN documents d USING (doc_id)),
b AS (SELECT doc_id, response, trim(replace(replace(response, '```json', ''), '```', ''), ' ') AS body FROM r),
p AS (SELECT *, CASE WHEN json_valid(body) THEN TRY_CAST(json_extract(body, '$.label') AS INTEGER) END AS lab,
                CASE WHEN json_valid(body) THEN json_extract_string(body, '$.reasoning') END AS rsn FROM b)
SELECT doc_id, CASE WHEN lab IS NOT NULL AND rsn IS NOT NULL THEN lab ELSE 1 END AS label,
       CASE WHEN response IS NULL OR trim(response) = '' THEN 'empty response'
            WHEN lab IS NULL OR rsn IS NULL THEN 'JSON ERROR: ' || response END AS error
FROM p
""")
def parse_label_response(spark, sf_dir):
    r = _responses(spark, sf_dir)
    p = PA.parse_label_response(F.col("response"), PA.SENTIMENT_SCHEMA, default=1)
    return r.select("doc_id", p["value"].alias("label"), p["error"].alias("error"))


# ---------------------------------------------------------------- C23, C24: rule labels

def _rules_sql(rules: R.RuleSet, src: str, id_col: str = "tweet_id") -> str:
    """The same first-match rule chain in DuckDB SQL (oracle only)."""
    def any_of(target, phrases):
        return "(" + " OR ".join(f"contains({target}, '{R.phrase_key(p)}')" for p in phrases) + ")"

    def cond(r: R.Rule) -> str:
        parts = []
        target = "b" if r.text_only else "t"
        for g in r.all_of:
            parts.append(any_of(target, g))
        if r.none_of:
            parts.append("NOT " + any_of(target, r.none_of))
        if r.tags:
            parts.append("list_has_any(h, [" + ", ".join(f"'{x.lower()}'" for x in r.tags) + "])")
        if r.hashtag_only:
            parts.append("bl = 0 AND len(h) > 0")
        return " AND ".join(parts) or "TRUE"
    typ = "BOOLEAN" if rules.label_type == "boolean" else "INTEGER"

    def lit(v):
        return "NULL" if v is None else (str(v).upper() if isinstance(v, bool) else str(v))
    whens = lambda f: " ".join(f"WHEN {cond(r)} THEN {f(r)}" for r in rules.rules)
    nw = "[^\\p{L}\\p{N}_]+"
    return f"""
WITH src AS ({src}),
y AS (SELECT {id_col}, lower(content) AS low,
             trim(regexp_replace(regexp_replace(lower(content), '(^|[^\\p{{L}}\\p{{N}}_])#[\\p{{L}}\\p{{N}}_]+', '\\1', 'g'),
                                 '\\s+', ' ', 'g')) AS bare
      FROM src),
x AS (SELECT {id_col}, ' ' || regexp_replace(low, '{nw}', ' ', 'g') || ' ' AS t,
             ' ' || regexp_replace(bare, '{nw}', ' ', 'g') || ' ' AS b, length(bare) AS bl,
             regexp_extract_all(low, '#[\\p{{L}}\\p{{N}}_]+') AS h
      FROM y)
SELECT {id_col},
       CAST(CASE {whens(lambda r: lit(r.label))} ELSE {lit(rules.default_label)} END AS {typ}) AS label,
       CAST(CASE {whens(lambda r: repr(float(r.confidence)))} ELSE {lit(rules.default_confidence)} END AS DOUBLE) AS confidence,
       CASE {whens(lambda r: "'" + r.name + "'")} ELSE 'default' END AS rule
FROM x
"""


def _triggers(rules: R.RuleSet) -> list[tuple[str, bool]]:
    """For each rule and each of its phrases a text that it fires on: (added words, replace the post?)."""
    out = []
    for r in rules.rules:
        tag = f" {r.tags[0]}" if r.tags else ""
        if r.hashtag_only:
            out += [(t, True) for t in r.tags]
            continue
        for k, group in enumerate(r.all_of):
            rest = " ".join(g[0] for i, g in enumerate(r.all_of) if i != k)
            out += [(f" {rest} {phrase}{tag}", False) for phrase in group]
        if not r.all_of:
            out += [(f" {t}", False) for t in r.tags]
    return out + [("", False)]


def _rule_query(name, rules, triggers=False):
    """The rules over the posts; with ``triggers`` every post also carries the words of one rule, in
    turn, so that each rule and each of its phrases decides some post."""
    cases = _triggers(rules) if triggers else [("", False)]

    def q(spark, sf_dir):
        posts, k, content = posts_from_documents(spark, sf_dir), F.pmod(F.col("tweet_id"), F.lit(len(cases))), F.col("content")
        for i, (words, alone) in enumerate(cases):
            content = F.when(k == i, F.lit(words) if alone else F.concat(F.col("content"), F.lit(words))).otherwise(content)
        out = R.rule_label(posts.withColumn("content", content), rules)
        return out.select("tweet_id", "label", "confidence", "rule")

    whens = " ".join(f"WHEN {i} THEN " + (f"'{w}'" if alone else f"concat(content, '{w}')") for i, (w, alone) in enumerate(cases))
    register(name, _rules_sql(rules, f"SELECT tweet_id, CASE tweet_id % {len(cases)} {whens} END AS content FROM ({POSTS_SQL})"))(q)


# Fixed values of the catalogue: a rule set over words that occur in the decorated posts view.
CATALOGUE_RULES = R.RuleSet(rules=(
    R.Rule("spam", False, 1.0, "spam word", all_of=(("wooow",),)),
    R.Rule("core", True, 1.0, "core phrase", all_of=(("kutipan lama", "lama"),), text_only=True),
    R.Rule("package", True, 1.0, "package with tag", all_of=(("negaradari",),), tags=("#topic1", "#topic2")),
    R.Rule("general", False, 1.0, "general mention", all_of=(("berita",),), text_only=True),
    R.Rule("opinion", True, 0.9, "opinion with tag", all_of=(("the", "la", "der"),), tags=("#topic3", "#topic4")),
    R.Rule("hashtag_only", True, 0.5, "tags only", tags=("#topic5",), hashtag_only=True),
    R.Rule("mismatch", False, 1.0, "tag without context", tags=("#topic6", "#tag_01")),
), default_label=False, default_confidence=1.0)

_rule_query("rule_label", R.RELEVANCE_RULES, triggers=True)
_rule_query("rule_label_catalogue", CATALOGUE_RULES)
_rule_query("sentiment_rules", R.SENTIMENT_RULES, triggers=True)


def _labeller(text: str) -> str:
    """A stand-in external labeller for the catalogue: a response per text (some malformed)."""
    n = len(text)
    if n % 11 == 0:
        return "```json\n{\"label\": 2, \"reasoning\": \"fenced\"}\n```"
    if n % 7 == 0:
        return "{\"label\": 0, \"reasoning\": \"trunc"
    return json.dumps({"label": n % 3, "reasoning": f"{n} characters"})


@register("bulk_label")
def bulk_label(spark, sf_dir):
    return R.label_with(posts_from_documents(spark, sf_dir), _labeller)


# ---------------------------------------------------------------- A1, A11, B4: raw items

@register("normalize_dump", """
SELECT CAST(event_id AS VARCHAR) AS tweet_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') AS time,
       CAST(user_id AS VARCHAR) AS author, event_type AS content,
       CAST(0 AS BIGINT) AS comment_count, CAST(floor(value) AS BIGINT) AS repost_count,
       CAST(user_id % 10 AS BIGINT) AS like_count, CAST(floor(value * 10) AS BIGINT) AS view_count
FROM events
""")
def normalize_dump(spark, sf_dir):
    """A1 over an extended-JSON dump built from ``events`` (``$oid``, ``$date`` wrappers)."""
    ev = table(spark, sf_dir, "events")
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS")
    dump = ev.select(
        F.struct(F.concat(F.lit("oid"), _s(F.col("event_id"))).alias("$oid")).alias("_id"),
        _s(F.col("event_id")).alias("tweet_id"),
        F.struct(F.concat(iso, F.lit("Z")).alias("$date")).alias("time"),
        _s(F.col("user_id")).alias("author"), F.col("event_type").alias("content"),
        F.lit(0).cast("long").alias("comment_count"), F.floor("value").cast("long").alias("repost_count"),
        (F.col("user_id") % 10).cast("long").alias("like_count"),
        F.floor(F.col("value") * 10).cast("long").alias("view_count"),
        F.struct(F.concat(iso, F.lit("ZZ")).alias("$date")).alias("created_at"), F.lit(0).alias("__v"))
    return IN.normalize_posts(dump)


def _v1_items(spark, sf_dir):
    cv = table(spark, sf_dir, "conversations")
    t = F.col("turn")
    return cv.select(
        "conv_id", "turn",
        F.when(t % 5 == 4, F.lit(None)).otherwise(F.lit("2024-02-01T10:00:00.000Z")).alias("time"),
        F.col("role").alias("author"),
        F.when(t % 7 == 6, F.lit(None)).otherwise(F.concat(F.lit("@user "), F.col("text"))).alias("content"),
        F.concat(_s(t), F.lit(" suka, "), _s(F.col("conv_id") % 9), F.lit(" balasan")).alias("data"))


_V1_SQL = """
v1 AS (SELECT conv_id, turn,
              CASE WHEN turn % 5 = 4 THEN NULL ELSE '2024-02-01T10:00:00.000Z' END AS time,
              role AS author,
              CASE WHEN turn % 7 = 6 THEN NULL ELSE concat('@user ', text) END AS content,
              concat(CAST(turn AS VARCHAR), ' suka, ', CAST(conv_id % 9 AS VARCHAR), ' balasan') AS data
       FROM conversations)
"""


@register("validate_posts", f"""
WITH {_V1_SQL}
SELECT conv_id, turn,
       CASE WHEN time IS NULL OR content IS NULL THEN
         'missing or not a string: ' || concat_ws(', ', CASE WHEN time IS NULL THEN 'time' END,
                                                   CASE WHEN content IS NULL THEN 'content' END) END AS reason
FROM v1
""")
def validate_posts(spark, sf_dir):
    valid, rejected = IN.validate_posts(_v1_items(spark, sf_dir), mode="row")
    return (valid.select("conv_id", "turn", F.lit(None).cast("string").alias("reason"))
            .unionByName(rejected.select("conv_id", "turn", "reason")))


@register("validate_posts_all", f"""
WITH {_V1_SQL},
b AS (SELECT *, time IS NULL OR content IS NULL AS bad,
             count(*) FILTER (WHERE time IS NULL OR content IS NULL) OVER (PARTITION BY conv_id) AS n_bad FROM v1)
SELECT conv_id, turn,
       CASE WHEN n_bad = 0 THEN NULL WHEN NOT bad THEN 'batch rejected' ELSE
         'missing or not a string: ' || concat_ws(', ', CASE WHEN time IS NULL THEN 'time' END,
                                                   CASE WHEN content IS NULL THEN 'content' END) END AS reason
FROM b
""")
def validate_posts_all(spark, sf_dir):
    """A11, batch mode: every conversation is a batch, taken or rejected whole."""
    valid, rejected = IN.validate_posts(_v1_items(spark, sf_dir), mode="all", batch_col="conv_id")
    return (valid.select("conv_id", "turn", F.lit(None).cast("string").alias("reason"))
            .unionByName(rejected.select("conv_id", "turn", "reason")))


@register("filter_min_content", f"""
WITH p AS ({POSTS_SQL}),
c AS (SELECT tweet_id, trim(regexp_replace(content, '@\\S+', '', 'g')) AS content FROM p)
SELECT tweet_id, content FROM c WHERE length(content) > 0 AND len(string_split(content, ' ')) >= 4
""")
def filter_min_content(spark, sf_dir):
    p = posts_from_documents(spark, sf_dir).select(
        "tweet_id", TX.strip_mentions("content").alias("content"))
    return IN.min_content(p, "content", min_words=4)


@register("ingest_v1", f"""
WITH {_V1_SQL},
c AS (SELECT author, coalesce(try_strptime(time, '%Y-%m-%dT%H:%M:%S.%gZ'), TIMESTAMP '{DEFAULT_TS}') AS time,
             trim(regexp_replace(content, '@\\S+', '', 'g')) AS content, turn, conv_id
      FROM v1 WHERE time IS NOT NULL AND content IS NOT NULL)
SELECT author, time, content, CAST(conv_id % 9 AS BIGINT) AS comment_count, CAST(turn AS BIGINT) AS like_count,
       CAST(0 AS BIGINT) AS repost_count, CAST(0 AS BIGINT) AS view_count
FROM c WHERE length(content) > 0 AND len(string_split(content, ' ')) >= 4
""")
def ingest_v1(spark, sf_dir):
    """A11 → C5 → C21 → B4 → C15 over raw v1 items."""
    valid, _ = IN.validate_posts(_v1_items(spark, sf_dir), mode="row")
    return IN.clean_v1(valid, F.lit(DEFAULT_TS).cast("timestamp_ntz"))


# ---------------------------------------------------------------- A8: insert-if-new

def _insert_inputs(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    key = F.concat(_s(F.col("user_id")), F.lit("-"), F.col("event_type"))
    batch = ev.select(key.alias("tweet_id"), F.col("ts").alias("time"), _s(F.col("event_id")).alias("content"))
    stored = ev.where(F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz")).where(F.col("value") < 5.0) \
        .select(key.alias("tweet_id"))
    return stored, batch


_INSERT_SQL = """
b AS (SELECT concat(CAST(user_id AS VARCHAR), '-', event_type) AS tweet_id, ts AS time,
             CAST(event_id AS VARCHAR) AS content FROM events),
st AS (SELECT DISTINCT concat(CAST(user_id AS VARCHAR), '-', event_type) AS tweet_id FROM events
       WHERE ts < TIMESTAMP '2024-01-16 00:00:00' AND value < 5.0),
f AS (SELECT tweet_id, time, content FROM (
        SELECT *, row_number() OVER (PARTITION BY tweet_id ORDER BY time, content) AS rn FROM b) WHERE rn = 1),
fresh AS (SELECT * FROM f WHERE tweet_id NOT IN (SELECT tweet_id FROM st))
"""


@register("insert_new", f"WITH {_INSERT_SQL} SELECT * FROM fresh")
def insert_new(spark, sf_dir):
    stored, batch = _insert_inputs(spark, sf_dir)
    fresh, _ = IN.insert_new(stored, batch, "tweet_id", order_col="time")
    return fresh


@register("insert_report", f"""
WITH {_INSERT_SQL}
SELECT (SELECT count(*) FROM fresh) AS pushed, (SELECT count(*) FROM b) - (SELECT count(*) FROM fresh) AS failed
""")
def insert_report(spark, sf_dir):
    stored, batch = _insert_inputs(spark, sf_dir)
    _, report = IN.insert_new(stored, batch, "tweet_id", order_col="time")
    return report


# ---------------------------------------------------------------- A10, C11: crawled pages

@register("extract_posts")
def extract_posts(spark, sf_dir):
    return IN.extract_posts(table(spark, sf_dir, "pages"))


@register("html_text")
def html_text(spark, sf_dir):
    from postlens.functions.unicode import html_get_text
    pages = table(spark, sf_dir, "pages").select("page_id", html_get_text("html").alias("_text"))
    return pages.select("page_id", *[TX.finish_page_text(F.col("_text"), v).alias(f"text_{v}")
                                     for v in ("alnum", "notags", "nfkc", "strip")])


# ---------------------------------------------------------------- E20–E22, B7: crawl state

def _log(spark, sf_dir):
    p = posts_from_events(spark, sf_dir)
    day = F.date_format(F.to_date("time"), "yyyy-MM-dd")
    return p.groupBy(day.alias("run_id")).agg(
        F.max("time").alias("started_at"),
        F.min(F.when(F.col("relevant"), F.col("time"))).alias("smallest_date"),
        F.max("time").alias("timeline_start_date"))


_LOG_SQL = f"""
p AS ({EVENTS_POSTS_SQL}),
lg AS (SELECT strftime(CAST(time AS DATE), '%Y-%m-%d') AS run_id, max(time) AS started_at,
              min(CASE WHEN relevant THEN time END) AS smallest_date, max(time) AS timeline_start_date
       FROM p GROUP BY 1)
"""


@register("crawl_watermark", f"""
WITH {_LOG_SQL},
bm AS (SELECT strftime(CAST(time AS DATE), '%Y-%m-%d') AS run_id, min(time) AS m FROM p
       WHERE content IS NOT NULL AND length(content) > 0 GROUP BY 1)
SELECT lg.run_id, lg.started_at, least(lg.smallest_date, bm.m) AS smallest_date, lg.timeline_start_date
FROM lg LEFT JOIN bm USING (run_id)
""")
def crawl_watermark(spark, sf_dir):
    posts = posts_from_events(spark, sf_dir).withColumn(
        "run_id", F.date_format(F.to_date("time"), "yyyy-MM-dd"))
    return CR.low_water_mark(_log(spark, sf_dir), posts)


@register("next_cursor", f"""
WITH {_LOG_SQL},
n AS (SELECT *, CASE WHEN timeline_start_date - smallest_date < INTERVAL 24 HOUR
                     THEN smallest_date - INTERVAL 1 DAY ELSE smallest_date END AS next_timeline_start FROM lg)
SELECT *, next_timeline_start < TIMESTAMP '2024-01-10 00:00:00' AS done FROM n
""")
def next_cursor(spark, sf_dir):
    return CR.next_cursor(_log(spark, sf_dir), until="2024-01-10 00:00:00")


@register("resume_run", f"WITH {_LOG_SQL} SELECT * FROM lg ORDER BY started_at DESC LIMIT 1")
def resume_run(spark, sf_dir):
    return CR.resume_run(_log(spark, sf_dir))


@register("oldest_post", f"WITH p AS ({EVENTS_POSTS_SQL}) SELECT min(time) AS oldest_time FROM p")
def oldest_post(spark, sf_dir):
    return CR.oldest_post_time(posts_from_events(spark, sf_dir))


@register("status_report", f"""
WITH {_LOG_SQL},
l AS (SELECT * FROM lg ORDER BY started_at DESC LIMIT 1)
SELECT l.run_id, l.started_at AS parsing_start_date, l.smallest_date AS current_timeline_from,
       l.timeline_start_date AS current_timeline_until, (SELECT count(*) FROM p) AS document_count
FROM l
""")
def status_report(spark, sf_dir):
    return SE.status_report(_log(spark, sf_dir), posts_from_events(spark, sf_dir))


@register("latest_posts", f"""
WITH p AS ({EVENTS_POSTS_SQL})
SELECT tweet_id, time AS created_at, author, content FROM p ORDER BY time DESC, tweet_id DESC LIMIT 10
""")
def latest_posts(spark, sf_dir):
    p = posts_from_events(spark, sf_dir).select("tweet_id", F.col("time").alias("created_at"), "author", "content")
    return SE.latest_posts(p, 10, "created_at", "tweet_id")


# ---------------------------------------------------------------- B2, B3, B5, B9

def _timed_posts(spark, sf_dir):
    posts = posts_from_documents(spark, sf_dir)
    ev = table(spark, sf_dir, "events").select(F.col("event_id").alias("tweet_id"), F.col("ts").alias("time"),
                                                F.col("value"))
    return posts.join(ev, "tweet_id", "left")


_TIMED_SQL = f"""
p AS ({POSTS_SQL}),
tp AS (SELECT p.*, e.ts AS time, e.value FROM p LEFT JOIN events e ON e.event_id = p.tweet_id)
"""


@register("search_posts", f"""
WITH {_TIMED_SQL}
SELECT tweet_id, time, author, content FROM tp
WHERE regexp_matches(content, '{SE.word_pattern("the")}') AND regexp_matches(content, '{SE.word_pattern("and")}')
  AND time >= TIMESTAMP '2024-01-01 06:00:00' AND time < TIMESTAMP '2024-01-02 00:00:00'
""")
def search_posts(spark, sf_dir):
    opts = SE.SearchOptions(includes=["the", "and"], since="2024-01-01 06:00:00", until="2024-01-02")
    out = SE.search_posts(_timed_posts(spark, sf_dir), opts)
    return out.select("tweet_id", "time", "author", "content")


@register("search_posts_either", f"""
WITH {_TIMED_SQL}
SELECT tweet_id, time, author, content FROM tp
WHERE regexp_matches(content, '{SE.any_word_pattern(["#topic1", "#topic2"])}')
  AND lower(author) = 'src3' AND NOT regexp_matches(content, '(?i)^rt\\s')
""")
def search_posts_either(spark, sf_dir):
    opts = SE.SearchOptions(either=["#topic1", "#topic2"], by="SRC3", timeline="TOP")
    out = SE.search_posts(_timed_posts(spark, sf_dir), opts)
    out = out.where(~F.col("content").rlike(r"(?i)^rt\s"))
    return out.select("tweet_id", "time", "author", "content")


@register("head_posts", f"WITH p AS ({POSTS_SQL}) SELECT tweet_id, author FROM p ORDER BY tweet_id LIMIT 5")
def head_posts(spark, sf_dir):
    return SE.head(posts_from_documents(spark, sf_dir).select("tweet_id", "author"), 5, "tweet_id")


@register("encode_labels", """
SELECT doc_id, lang, CAST(dense_rank() OVER (ORDER BY lang) - 1 AS INTEGER) AS lang_id FROM documents
""")
def encode_labels(spark, sf_dir):
    return SE.encode_labels(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang")


@register("with_defaults", """
SELECT doc_id, quality, FALSE AS relevant, 1 AS sentiment FROM labels
""")
def with_defaults(spark, sf_dir):
    lab = table(spark, sf_dir, "labels").select("doc_id", "quality")
    out = SE.with_defaults(lab, {"relevant": False, "sentiment": 0})
    return SE.with_defaults(out, {"sentiment": 1}, overwrite=True)


@register("relevant_filter", f"""
WITH p AS ({EVENTS_POSTS_SQL}) SELECT tweet_id, sentiment FROM p WHERE relevant = TRUE AND sentiment = 2
""")
def relevant_filter(spark, sf_dir):
    p = SE.equals(SE.equals(posts_from_events(spark, sf_dir), "relevant", True), "sentiment", 2)
    return p.select("tweet_id", "sentiment")


# ---------------------------------------------------------------- A2, A3, A7, A9: files

@register("split_roundtrip", """
WITH k AS (SELECT doc_id, lang, ('0x' || substr(md5('42:' || CAST(doc_id AS VARCHAR)), 1, 15))::BIGINT AS key
           FROM documents),
r AS (SELECT doc_id, lang, row_number() OVER (ORDER BY key, doc_id) AS rank, count(*) OVER () AS n FROM k)
SELECT doc_id, lang, CASE WHEN rank <= ceil(n * 0.2 - 1e-9) THEN 'test' ELSE 'train' END AS split FROM r
""")
def split_roundtrip(spark, sf_dir):
    """A3 (+A9): publish the train/test splits of the documents as Parquet split folders and a
    text-lines file under the shared checkpoint folder, then read all splits back."""
    from postlens.operators import sampling as S
    from postlens.streaming.ingest import scratch_path
    root = scratch_path(spark, "splits")
    sp = S.split_exact(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id", test=0.2)
    for name in ("train", "test"):
        IN.write_split(sp.where(F.col("split") == name).drop("split"), root, name)
    IN.write_lines(posts_from_documents(spark, sf_dir), scratch_path(spark, "lines"))
    return IN.read_split(spark, root)


@register("json_roundtrip", """
SELECT CAST(event_id AS VARCHAR) AS tweet_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') AS time,
       CAST(user_id AS VARCHAR) AS author, event_type AS content, CAST(0 AS BIGINT) AS comment_count,
       CAST(0 AS BIGINT) AS repost_count, CAST(0 AS BIGINT) AS like_count, CAST(0 AS BIGINT) AS view_count
FROM events
""")
def json_roundtrip(spark, sf_dir):
    """A2 + A1: an extended-JSON dump of the events written as JSON and read back with an
    explicit schema, then normalised."""
    from postlens.streaming.ingest import scratch_path
    path = scratch_path(spark, "dump")
    ev = table(spark, sf_dir, "events")
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS")
    ev.select(F.struct(F.concat(F.lit("oid"), _s(F.col("event_id"))).alias("$oid")).alias("_id"),
              _s(F.col("event_id")).alias("tweet_id"),
              F.struct(F.concat(iso, F.lit("Z")).alias("$date")).alias("time"),
              _s(F.col("user_id")).alias("author"), F.col("event_type").alias("content"),
              F.lit(0).cast("long").alias("comment_count"), F.lit(0).cast("long").alias("repost_count"),
              F.lit(0).cast("long").alias("like_count"), F.lit(0).cast("long").alias("view_count"),
              F.struct(F.concat(iso, F.lit("Z")).alias("$date")).alias("created_at"),
              F.lit(0).alias("__v")).write.json(path)
    return IN.normalize_posts(spark.read.schema(IN.RAW_DUMP_SCHEMA).json(path))


@register("json_array_read", """
SELECT CAST(event_id AS VARCHAR) AS tweet_id, CAST(user_id AS VARCHAR) AS author, event_type AS content, '1 suka' AS data,
       strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') AS time FROM events
""")
def json_array_read(spark, sf_dir):
    """A2: dump files that hold one JSON array each (a thousand records a file), read as records."""
    from postlens.streaming.ingest import scratch_path
    path = scratch_path(spark, "arrays")
    ev = table(spark, sf_dir, "events")
    item = F.struct(_s(F.col("event_id")).alias("tweet_id"), _s(F.col("user_id")).alias("author"), F.col("event_type").alias("content"),
                    F.lit("1 suka").alias("data"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS").alias("time"))
    part = F.floor(F.col("event_id") / 1000).alias("part")
    (ev.groupBy(part).agg(F.to_json(F.collect_list(item)).alias("value")).write.option("maxRecordsPerFile", 1)
     .partitionBy("part").text(path))
    schema = "tweet_id string, author string, content string, data string, time string"
    return IN.read_json_array(spark, f"{path}/*", spark.createDataFrame([], schema).schema)


@register("lines_roundtrip", f"""
WITH p AS ({POSTS_SQL})
SELECT trim(regexp_replace(content, '\\s+', ' ', 'g')) AS line, count(*) AS cnt FROM p GROUP BY 1
""")
def lines_roundtrip(spark, sf_dir):
    """Posts on one line each written as a text file and read back."""
    from postlens.streaming.ingest import scratch_path
    path = scratch_path(spark, "lines")
    one = F.trim(F.regexp_replace("content", r"\s+", " "))
    IN.write_lines(posts_from_documents(spark, sf_dir).select(one.alias("content")), path)
    return spark.read.text(path).groupBy(F.col("value").alias("line")).agg(F.count(F.lit(1)).alias("cnt"))


@register("labelled_dir", """
SELECT d.text || chr(10) AS text, CASE WHEN l.quality = 1 THEN 1 ELSE 0 END AS label
FROM labels l JOIN documents d USING (doc_id)
""")
def labelled_dir(spark, sf_dir):
    """Documents written as one text file each under pos/ (quality 1) and neg/ (quality 0),
    then read back with labels from the folder names."""
    from postlens.streaming.ingest import scratch_path
    root = scratch_path(spark, "corpus")
    lab = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id")
    folder = F.when(F.col("quality") == 1, F.lit("pos")).otherwise(F.lit("neg"))
    IN.write_labelled_dir(lab.select(folder.alias("folder"), "text"), root)      # one document per file
    return IN.read_labelled_dir(spark, root).select("text", "label")
