"""Engagement strings, K/M counts and labeller responses (FIXTURES §2 edge rows)."""

from pyspark.sql import functions as F

from postlens.functions import parse as P


def _metrics(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "s STRING")
    return [r[0].asDict() if r[0] is not None else None
            for r in df.select(P.parse_metrics("s")).collect()]


def test_engagement_strings(spark):
    got = _metrics(spark, ["1,2 rb suka, 5 balasan", "3 jt tayangan", "1.234 suka",
                           "7 suka, 2 suka", "4 entah", ""])
    assert got[0]["likes"] == 1200 and got[0]["replies"] == 5
    assert got[1]["views"] == 3_000_000
    assert got[2]["likes"] == 1                     # thousands dot read as a decimal point
    assert got[3]["likes"] == 2                     # a later item wins
    assert all(v is None for v in got[4].values())  # unknown label ignored
    assert all(v is None for v in got[5].values())


def test_engagement_locale_id(spark):
    df = spark.createDataFrame([("1.234 suka",)], "s STRING")
    assert df.select(P.parse_metrics("s", locale="id")["likes"]).first()[0] == 1234


def test_km_counts(spark):
    df = spark.createDataFrame([(t,) for t in ["1,234", "1.5K", "2M", "", "abc", None, "17"]], "s STRING")
    got = [r[0] for r in df.select(P.parse_km("s")).collect()]
    assert got == [1234.0, 1500.0, 2_000_000.0, 0.0, 0.0, 0.0, 17.0]


def test_label_responses(spark):
    rows = ['{"label": 2, "reasoning": "x"}', '```json\n{"label": 0, "reasoning": "y"}\n```',
            '{"label": 1, "reasoning": "trunc', '{"reasoning": "no label"}', '', None,
            '{"label": "two", "reasoning": "wrong type"}']
    df = spark.createDataFrame([(r,) for r in rows], "r STRING")
    out = df.select(P.parse_label_response("r", P.SENTIMENT_SCHEMA, default=1).alias("p")).collect()
    vals = [o["p"]["value"] for o in out]
    errs = [o["p"]["error"] for o in out]
    assert vals == [2, 0, 1, 1, 1, 1, 1]
    assert errs[0] is None and errs[1] is None
    assert all(e is not None for e in errs[2:])


def test_relevance_schema(spark):
    df = spark.createDataFrame([('{"is_related_to_ruu_tni": true, "confidence": 0.9}',)], "r STRING")
    p = df.select(P.parse_label_response("r", P.RELEVANCE_SCHEMA, default=False).alias("p")).first()["p"]
    assert p["value"] is True and p["parsed"]["confidence"] == 0.9


def test_engagement_edge_items(spark):
    got = _metrics(spark, ["5 suka,suka", ",5 suka", "2 rb posting ulang, 9 markah, 1 Tayangan", "12, suka"])
    assert got[0]["likes"] is None                    # the second item has no number: NaN
    assert got[1]["likes"] == 1                       # ",5" reads as 0.5, rounded half up
    assert (got[2]["retweets"], got[2]["bookmarks"], got[2]["views"]) == (2000, 9, 1)
    assert got[3]["likes"] == 12


def _js_metrics(text):
    """Left-to-right scan with JavaScript semantics (Python re behaves the same here)."""
    import math
    import re
    out = {}
    for m in re.finditer(r"([\d.,]+)\s*(rb|jt)?\s*([a-z\s]+?)(?=,|$)", text.lower()):
        lit = re.match(r"^\s*([+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?)", m.group(1).replace(",", ".", 1))
        num = float(lit.group(1)) if lit else math.nan
        num *= {"rb": 1000, "jt": 1_000_000}.get(m.group(2), 1)
        key = P.METRIC_LABELS.get(m.group(3).strip())
        if key:
            out[key] = None if math.isnan(num) else math.floor(num + 0.5)
    return {k: out.get(k) for k in P.METRICS}


def test_engagement_random_strings_match_scan(spark):
    import random
    rnd = random.Random(11)
    parts = ["1,2", "5", "3.4", ",5", "12,", "7", " rb", " jt", "rb", " suka", " balasan", " tayangan",
             " posting ulang", " markah", " entah", ", ", ",", " ", "x", "  suka"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(1, 9))) for _ in range(400)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i INT, s STRING")
    for _ in (0,):
        got = [r[0].asDict() for r in df.orderBy("i").select(P.parse_metrics("s")).collect()]
        for t, g in zip(texts, got):
            assert g == _js_metrics(t), t


def test_every_rule_decides_some_post(spark):
    """The checked rule queries are not mostly default: each rule of the study fires."""
    import __spark_entry__ as entry
    from postlens.operators import rules as R
    for name, rules in (("rule_label", R.RELEVANCE_RULES), ("sentiment_rules", R.SENTIMENT_RULES)):
        counts = {r["rule"]: r["count"] for r in entry.queries()[name](spark, "/root/testdata/sf0.01").groupBy("rule").count().collect()}
        assert {r.name for r in rules.rules} <= set(counts), counts
        assert counts.get("default", 0) < 0.3 * sum(counts.values()), counts


def test_opinion_needs_text(spark):
    from postlens.operators import rules as R
    df = spark.createDataFrame([("#tolak #ruutni",), ("saya tolak #ruutni",)], "content string")
    assert [r["rule"] for r in R.rule_label(df, R.RELEVANCE_RULES).collect()] == ["layer4b_hashtag_only", "layer4a_opinion"]
