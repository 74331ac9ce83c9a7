"""Cleaning steps, tokens, hashtags and stop words on hand-made edge rows, checked against a
small Python ``re`` oracle of the same rules (Python regex semantics are the specification)."""

import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from postlens.functions import text as T

EDGE = [
    None, "", "@only", "tiga kata saja", "empat kata di sini", "ＡＢＣ　full width １２３",
    "senang 😂 sekali", "lihat https://x ini tidak tersedia ya", "wooow mantap!!!", "tahun 2025an ramai",
    "berita negaradari a.example hari ini", "ini Kutipan lama\nbaris dua", "baris satu\nbaris dua",
    "RT @budi: tolak #RUUTNI sekarang", "rt  ganda", "anarko!dari kompas.com heboh", "kabar dari detik.com",
    "bangeeet ruu tni", "tanya grok apa ini", "teks \\n dengan escape",
]


def _df(spark, rows=EDGE):
    return spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "id INT, content STRING")


def _run(spark, col_fn, rows=EDGE):
    out = _df(spark, rows).select("id", col_fn(F.col("content")).alias("out")).orderBy("id").collect()
    return [r["out"] for r in out]


# -- Python oracle of the individual rules -------------------------------------------------

def py_url(t):
    return re.sub(r"https?://\S+", " <url> ", t)


def py_mention(t):
    return re.sub(r"@\w+", "@USER", t)


def py_rt_year_cut(t):
    t = re.sub(r"^rt\s+", "", t, flags=re.I)
    t = re.sub(r"(\b\d{4})(?=[a-zA-Z])", r"\1 ", t)
    return re.sub(r"(?i)kutipan.*$", "", t, flags=re.DOTALL)


def py_dari(t):
    t = re.sub(r"(\S+)dari\s+([a-z0-9.-]+\.[a-z]{2,})\b", r"\1", t, flags=re.I)
    t = re.sub(r"\s+dari\s+([a-z0-9.-]+\.[a-z]{2,})\b", "", t, flags=re.I)
    t = re.sub(r"(\S+)dari\b", r"\1", t, flags=re.I)
    return re.sub(r"\b[a-z0-9.-]+\.[a-z]{2,}\b", " ", t, flags=re.I)


def py_repeat(t):
    return re.sub(r"(.)\1{2,}", r"\1", t)


def py_hashtags_removed(t):
    t = re.sub(r"(?<!\w)#[\w_]+", "", t)
    return re.sub(r"\s+", " ", t).strip()


def py_tokens(t):
    return re.findall(r"(#\w+|\b\w\w+\b)", t.lower())


@pytest.mark.parametrize("fn,oracle", [
    (T.url_token, py_url), (T.mention_token, py_mention),
    (lambda c: T.quote_cut(T.year_split(T.rt_prefix(c))), py_rt_year_cut),
    (T.dari_domain, py_dari), (T.squeeze_repeats, py_repeat),
    (T.remove_hashtags, py_hashtags_removed),
])
def test_steps_match_python_rules(spark, fn, oracle):
    got = _run(spark, fn)
    want = [None if t is None else oracle(t) for t in EDGE]
    assert got == want


def test_tokens_match_python(spark):
    got = _run(spark, T.tokens)
    want = [None if t is None else py_tokens(t) for t in EDGE]
    assert got == want


def test_hashtags_lowercase(spark):
    got = _run(spark, T.extract_hashtags, ["#Tolak #RUU_TNI ok", "no tags", "a#b ##c"])
    assert got == [["#tolak", "#ruu_tni"], [], ["#b", "#c"]]


def test_stopwords_whitespace_split(spark):
    stop = {"dan", "the"}
    got = _run(spark, lambda c: T.remove_stopwords(c, stop), ["  The cat  DAN dog ", "", "dan"])
    assert got == ["cat dog", "", ""]


def test_ngrams_guard_short_arrays(spark):
    df = spark.createDataFrame([(["a", "b", "c"],), ([],), (["x"],)], "t ARRAY<STRING>")
    got = [r[0] for r in df.select(T.ngrams(F.col("t"), 1, 3)).collect()]
    assert got == [["a", "b", "c", "a b", "b c", "a b c"], [], ["x"]]


def test_full_cleaner_examples(spark):
    rows = ["RT @budi: Tolak #RUUTNI https://t.co/x ini tidak tersedia 2025an bangeeet",
            "ＡＢＣ　１２３", "berita negaradari a.example Kutipan lama", "tanya grok apa"]
    got = _run(spark, T.clean_post, rows)
    assert got[0] == "@user: tolak #ruutni <url> ini tidak tersedia 2025 an banget"
    assert got[1] == unicodedata.normalize("NFKC", "ＡＢＣ　１２３").lower()
    assert got[2] == "berita negara"
    assert got[3] == "apa"


def test_clean_is_idempotent_on_clean_text(spark):
    once = _run(spark, T.clean_post, ["halo dunia ini teks bersih"])
    assert once == ["halo dunia ini teks bersih"]


def test_html_text_variants(spark):
    html = "<html><head><style>p{}</style><script>x=1</script></head><body><p>Hi [x] there, it's &amp; ok</p></body></html>"
    df = spark.createDataFrame([(html,)], "h STRING")
    r = df.select(*[T.html_to_text("h", v).alias(v) for v in ("alnum", "notags", "nfkc", "strip")]).first()
    assert r["strip"] == "Hi [x] there, it's & ok"
    assert r["alnum"] == "Hi  there, it's  ok"


def test_zero_pad_never_shortens(spark):
    df = spark.createDataFrame([(5,), (42,), (1234,)], "n INT")
    assert [r[0] for r in df.select(T.zero_pad("n")).collect()] == ["005", "042", "1234"]


def test_parse_time_default(spark):
    df = spark.createDataFrame([("2025-03-20T10:11:12.000Z",), ("DATEUNDEFINED",), (None,)], "t STRING")
    d = F.lit("2000-01-01 00:00:00").cast("timestamp_ntz")
    got = [str(r[0]) for r in df.select(T.parse_time_or("t", d)).collect()]
    assert got == ["2025-03-20 10:11:12", "2000-01-01 00:00:00", "2000-01-01 00:00:00"]
