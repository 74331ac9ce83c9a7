"""Column parsers: Indonesian engagement strings, K/M counts and labeller
responses.  All native expressions: regex extraction, higher-order array functions, ``from_json``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Engagement labels → metric names, and unit multipliers.
METRIC_LABELS = {"tayangan": "views", "suka": "likes", "posting ulang": "retweets",
                 "balasan": "replies", "markah": "bookmarks"}
UNIT_MULTIPLIERS = {"rb": 1_000, "jt": 1_000_000}
#: Marks around the parts of an item found in an engagement string.
_START, _NEXT, _END = "\x03", "\x01", "\x02"
METRICS = ("views", "likes", "retweets", "replies", "bookmarks")


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def js_parse_float(s: Column) -> Column:
    """JavaScript ``parseFloat``: the longest leading decimal literal (after leading whitespace);
    NULL when there is none (JavaScript's NaN)."""
    lit = F.regexp_extract(s, r"^\s*([+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?)", 1)
    return F.nullif(lit, F.lit("")).cast("double")


def js_round(x: Column) -> Column:
    """JavaScript ``Math.round`` (halves round up)."""
    return F.floor(x + F.lit(0.5)).cast("long")


def parse_metrics(c, locale: str = "reference") -> Column:
    """``'1,2 rb suka, 5 balasan'`` → STRUCT<views, likes, retweets, replies, bookmarks>.

    Every item is matched (case-insensitive); the first comma of the number becomes a dot and
    the longest numeric prefix is read (so ``1.234`` reads as 1.234 with ``locale='reference'``;
    ``locale='id'`` reads dots as thousands separators); ``rb`` ×1e3, ``jt`` ×1e6; unknown labels
    are ignored; when a label repeats, the later item wins; values are rounded.

    One scan of the item pattern: each item becomes ``number, unit, label`` between marks that no input holds,
    and each metric reads what stands before the last occurrence of its label.  Possessive parts cannot
    match otherwise: a number is followed by no digit or separator, words by a comma or the end."""
    s = F.lower(_col(c))
    for mark in (_START, _NEXT, _END):
        s = F.replace(s, F.lit(mark), F.lit("#"))
    item = r"(?Us)([0-9.,]++)\s*+(rb|jt)?\s*([a-z]++(?:\s++[a-z]++)*+)\s*+(?=,|\z)"
    found = F.regexp_replace(s, item, f"{_START}$1{_NEXT}$2{_NEXT}$3{_END}")

    def metrics(x: Column) -> Column:
        def last(label: str) -> Column:
            key = f"{_NEXT}{label}{_END}"
            read = F.substring_index(F.substring_index(F.substring_index(x, key, -2), key, 1), _START, -1)
            return F.when(x.contains(key), _item_value(F.substring_index(read, _NEXT, 1), F.substring_index(read, _NEXT, -1), locale))
        return F.struct(*[last(label).alias(name) for label, name in METRIC_LABELS.items()])

    return F.when(s.isNotNull(), F.element_at(F.transform(F.array(found), metrics), 1))


def _item_value(raw: Column, unit: Column, locale: str) -> Column:
    """``raw`` holds digits, dots and commas only: the number ends at its second separator."""
    raw = F.replace(raw if locale != "id" else F.replace(raw, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    num = F.substring_index(raw, ".", 2).try_cast("double")
    mult = (F.when(unit == "rb", F.lit(1000.0))
            .when(unit == "jt", F.lit(1_000_000.0)).otherwise(F.lit(1.0)))
    return js_round(num * mult)


def parse_km(c) -> Column:
    """``'1,234'`` → 1234, ``'1.5K'`` → 1500, ``'2M'`` → 2000000 (K/M floored); empty, NULL
    or not a number → 0."""
    s = F.regexp_replace(_col(c), ",", "")
    low = F.lower(_col(c))
    num = js_parse_float(s)
    val = (F.when(low.endswith("k"), F.floor(num * 1000.0))
           .when(low.endswith("m"), F.floor(num * 1_000_000.0))
           .otherwise(num))
    return F.when((_col(c).isNull()) | (_col(c) == ""), F.lit(0.0)) \
        .otherwise(F.coalesce(val.cast("double"), F.lit(0.0)))


# The two response schemas of the labelling study.
RELEVANCE_SCHEMA = T.StructType([T.StructField("is_related_to_ruu_tni", T.BooleanType()),
                                 T.StructField("confidence", T.DoubleType())])
SENTIMENT_SCHEMA = T.StructType([T.StructField("label", T.IntegerType()),
                                 T.StructField("reasoning", T.StringType())])


def strip_fences(c) -> Column:
    """Remove Markdown code fences (```json … ```) around a response."""
    s = F.regexp_replace(_col(c), r"```json", "")
    return F.trim(F.regexp_replace(s, r"```", ""))


def parse_label_response(c, schema: T.StructType = SENTIMENT_SCHEMA, default=None,
                         target: str | None = None) -> Column:
    """STRUCT<value, parsed, error>.  The response is unfenced and parsed with ``schema``;
    when it is not valid JSON, or a required field is missing or of the wrong type, ``value`` is
    ``default`` and ``error`` says why."""
    body = strip_fences(c)
    parsed = F.from_json(body, schema, {"mode": "PERMISSIVE"})
    fields = [f.name for f in schema.fields]
    ok = F.lit(True)
    for f in fields:
        ok = ok & parsed[f].isNotNull()
    target = target or fields[0]
    value = F.when(ok, parsed[target]).otherwise(F.lit(default).cast(schema[target].dataType))
    error = (F.when(_col(c).isNull() | (F.trim(_col(c)) == ""), F.lit("empty response"))
             .when(parsed.isNull() | ~ok, F.concat(F.lit("JSON ERROR: "), _col(c))))
    return F.struct(value.alias("value"), parsed.alias("parsed"), error.alias("error"))
