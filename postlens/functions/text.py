"""Column-level text functions: cleaning steps, tokens, n-grams, stop words,
hashtags, time parsing and padding.

All are native Spark expressions (``regexp_replace``, ``regexp_extract_all``, higher-order array
functions) and stay inside whole-stage code generation.  Patterns are written for Java regex with
Python-like Unicode semantics: ``\\w`` is spelled ``[\\p{L}\\p{N}_]`` (letters, numbers,
underscore) and ``(?U)`` makes ``\\s``, ``\\S``, ``\\b`` and ``\\d`` Unicode-aware.
Only NFKC and emoji names need Python (``postlens.functions.unicode``).
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

W = r"[\p{L}\p{N}_]"          # a word character
NW = r"[^\p{L}\p{N}_]"        # a non-word character
WS = r"[\s\x{1c}-\x{1f}]"      # whitespace (with (?U)), as Python's str.isspace

# Literal strings the reference removes or rewrites.
GROK_LITERALS = ("tanya grok", "grokproductivitypasang")
UNAVAILABLE = "ini tidak tersedia"
URL_TOKEN = " <url> "
MENTION_TOKEN = "@USER"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def replace_literal(c, old: str, new: str) -> Column:
    return F.replace(_col(c), F.lit(old), F.lit(new))


def drop_grok(c) -> Column:
    c = _col(c)
    for lit in GROK_LITERALS:
        c = replace_literal(c, lit, " ")
    return c


def literal_escapes_to_space(c) -> Column:
    """The two-character sequences backslash-n and backslash-r become a space."""
    return replace_literal(replace_literal(c, "\\n", " "), "\\r", " ")


def url_token(c, token: str = URL_TOKEN) -> Column:
    """C4: every ``https?://…`` run becomes `` <url> ``."""
    return F.regexp_replace(_col(c), r"(?U)https?://\S+", token)


def remove_urls(c) -> Column:
    """C3 step: ``http\\S+|www\\S+`` removed."""
    return F.regexp_replace(_col(c), r"(?U)http\S+|www\S+", "")


def drop_unavailable(c, after_url: bool = True) -> Column:
    """`` <url> ini tidak tersedia`` (C1: only right after a URL token) or the phrase anywhere."""
    old = "<url> " + UNAVAILABLE if after_url else UNAVAILABLE
    return replace_literal(c, old, " ")


def mention_token(c, token: str = MENTION_TOKEN) -> Column:
    """``@word`` becomes ``@USER``."""
    return F.regexp_replace(_col(c), "@" + W + "+", token)


def strip_mentions(c) -> Column:
    """C5 (ingest): ``@[^\\s]+`` removed, then the text is trimmed."""
    return trim_ws(F.regexp_replace(_col(c), r"(?U)@\S+", ""))


def rt_prefix(c) -> Column:
    """A leading ``rt`` + whitespace is removed (case-insensitive)."""
    return F.regexp_replace(_col(c), r"(?iU)^rt\s+", "")


def year_split(c) -> Column:
    """A space after four digits that run straight into a Latin letter (``2025an``)."""
    return F.regexp_replace(_col(c), r"(?U)(\b\d{4})(?=[a-zA-Z])", "$1 ")


def quote_cut(c) -> Column:
    """Everything from ``kutipan`` (any case) to the end, newlines included, is cut."""
    return F.regexp_replace(_col(c), r"(?is)kutipan.*$", "")


# The three ordered ``dari`` + domain rules and the bare-domain rule.
DARI_ATTACHED = r"(?iU)(\S+)dari\s+([a-z0-9.-]+\.[a-z]{2,})\b"
DARI_SPACED = r"(?iU)\s+dari\s+([a-z0-9.-]+\.[a-z]{2,})\b"
DARI_STUCK = r"(?iU)(\S+)dari\b"
DOMAIN_ONLY = r"(?iU)\b[a-z0-9.-]+\.[a-z]{2,}\b"


def dari_domain(c) -> Column:
    """``xdari site.com`` → ``x``; `` dari site.com`` → ``; ``xdari`` → ``x``; bare domains → space."""
    return let(_col(c), lambda x: F.regexp_replace(let(x, _dari), DOMAIN_ONLY, " "))


def _dari(c: Column) -> Column:
    """The three rules; texts without the word pay a substring test."""
    cut = F.regexp_replace(c, DARI_ATTACHED, "$1")
    cut = F.regexp_replace(cut, DARI_SPACED, "")
    cut = F.regexp_replace(cut, DARI_STUCK, "$1")
    return F.when(F.lower(c).contains("dari") | F.upper(c).contains("DARI"), cut).otherwise(c)


def let(value: Column, body) -> Column:
    """``body(x)`` with x evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def squeeze_repeats(c) -> Column:
    """Three or more of the same character (newline excluded) become one."""
    return F.regexp_replace(_col(c), r"([^\n])\1{2,}", "$1")


def squeeze_word_repeats(c) -> Column:
    """C3 step: three or more of the same word character become one."""
    return F.regexp_replace(_col(c), "(" + W + r")\1{2,}", "$1")


def trim_ws(c) -> Column:
    return F.regexp_replace(_col(c), r"(?U)^" + WS + "+|" + WS + "+$", "")


def collapse_ws(c) -> Column:
    """Whitespace runs become one space; leading and trailing whitespace removed."""
    return F.trim(F.regexp_replace(_col(c), "(?U)" + WS + "+", " "))


def clean_post(c) -> Column:
    """The full post cleaner, steps in the reference's order."""
    from postlens.functions.unicode import demojize, fold_width
    c = fold_width(_col(c))
    c = drop_grok(c)
    c = literal_escapes_to_space(c)
    c = url_token(c)
    c = drop_unavailable(c, after_url=True)
    c = mention_token(c)
    c = rt_prefix(c)
    c = year_split(c)
    c = quote_cut(c)
    c = dari_domain(c)
    c = demojize(c)
    c = squeeze_repeats(c)
    return F.lower(collapse_ws(c))


def clean_dataset(c) -> Column:
    """The dataset cleaner (no dari/domain/emoji/repeat rules, no lower-casing)."""
    from postlens.functions.unicode import fold_width
    c = fold_width(_col(c))
    c = drop_grok(c)
    c = literal_escapes_to_space(c)
    c = url_token(c)
    c = drop_unavailable(c, after_url=False)
    c = mention_token(c)
    c = rt_prefix(c)
    c = year_split(c)
    c = quote_cut(c)
    return collapse_ws(c)


def clean_for_embedding(c) -> Column:
    """Lower → URLs removed → ``rt @x``/``@x`` removed → ``#w`` → ``w`` → emoji names →
    word-character repeats squeezed → whitespace collapsed."""
    from postlens.functions.unicode import demojize
    c = F.lower(_col(c))
    c = remove_urls(c)
    c = F.regexp_replace(c, r"(?U)rt @\S+|@\S+", "")
    c = F.regexp_replace(c, r"(?U)#(\S+)", "$1")
    c = demojize(c)
    c = squeeze_word_repeats(c)
    return collapse_ws(c)


# ---------------------------------------------------------------- hashtags, tokens, stop words

HASHTAG = "#" + W + "+"
# A hashtag, or a run of two or more word characters (the tokenizer of the keyword study).
TOKEN = HASHTAG + "|" + W + "{2,}"


def extract_hashtags(c) -> Column:
    """C14: hashtags of the lower-cased text, in order."""
    return F.regexp_extract_all(F.lower(_col(c)), F.lit(HASHTAG), 0)


def remove_hashtags(c) -> Column:
    """Hashtags not preceded by a word character are removed; whitespace collapsed."""
    return collapse_ws(F.regexp_replace(_col(c), "(?<!" + W + ")" + HASHTAG, ""))


def tokens(c) -> Column:
    """E3 tokenizer: lower-case, then hashtags and words of at least two characters."""
    return F.regexp_extract_all(F.lower(_col(c)), F.lit(TOKEN), 0)


def drop_stopwords(arr: Column, stopwords: Iterable[str], lower: bool = False) -> Column:
    """Remove array elements that are stop words (``lower`` compares the lower-cased element).
    The list is a literal set: Catalyst turns the membership test into a hash lookup."""
    stop = sorted({w.lower() for w in stopwords})
    if lower:
        return F.filter(arr, lambda w: ~F.lower(w).isin(stop))
    return F.filter(arr, lambda w: ~w.isin(stop))


def split_ws(c) -> Column:
    """Python ``str.split()``: split on whitespace runs, no empty pieces."""
    return F.filter(F.split(_col(c), "(?U)" + WS + "+"), lambda w: w != "")


def remove_stopwords(c, stopwords: Iterable[str]) -> Column:
    """Whitespace split, drop words whose lower case is a stop word, join with one space."""
    return F.array_join(drop_stopwords(split_ws(c), stopwords, lower=True), " ")


def ngrams(arr: Column, n_min: int = 1, n_max: int = 5) -> Column:
    """All contiguous n-grams (n_min..n_max) of a token array, each joined by one space.
    Pass a column reference: the array is read once per n-gram."""
    size = F.size(arr)

    def grams_of(n: int) -> Column:
        # (one-argument lambdas: Spark reads a second lambda argument as the element index)
        starts = F.filter(F.sequence(F.lit(0), F.greatest(size - 1, F.lit(0))),
                          lambda i: i + n <= size)
        return F.transform(starts, lambda i: F.array_join(F.slice(arr, i + 1, n), " "))

    return F.flatten(F.array(*[grams_of(n) for n in range(n_min, n_max + 1)]))


def avg_word_length(words: Column) -> Column:
    """Mean length of the words of an array (NULL for an empty array).  Pass a column
    reference (the array is read twice)."""
    total = F.aggregate(words, F.lit(0), lambda acc, w: acc + F.length(w))
    return F.when(F.size(words) > 0, total / F.size(words))


# ---------------------------------------------------------------- dates and numbers

def parse_time_or(c, default: Column | None = None) -> Column:
    """ISO text → TIMESTAMP_NTZ (UTC wall time); invalid or ``DATEUNDEFINED`` → default
    (the ingest time when not given)."""
    parsed = F.try_to_timestamp(_col(c)).cast("timestamp_ntz")
    fallback = default if default is not None else F.current_timestamp().cast("timestamp_ntz")
    return F.coalesce(parsed, fallback)


def zero_pad(c, width: int = 3) -> Column:
    """Left-pad with zeros to ``width``; longer values are kept whole."""
    s = _col(c).cast("string")
    return F.when(F.length(s) >= width, s).otherwise(F.lpad(s, width, "0"))


# ---------------------------------------------------------------- C11: HTML to text

def html_to_text(c, variant: str = "strip") -> Column:
    """C11: page text (script/style/comments dropped) then one of four finishes (see
    ``finish_page_text``)."""
    from postlens.functions.unicode import html_get_text
    return finish_page_text(html_get_text(_col(c)), variant)


def finish_page_text(t: Column, variant: str = "strip") -> Column:
    """C11 finishes of extracted page text:
    ``alnum``  – bracketed parts removed, only ASCII letters, digits, whitespace, comma, quote kept;
    ``notags`` – leftover tag-like text removed;  ``nfkc`` – NFKC, control characters removed;
    ``strip``  – surrounding whitespace removed."""
    from postlens.functions.unicode import nfkc
    if variant == "alnum":
        t = F.regexp_replace(t, r"\[[^]]*\]", "")
        return F.regexp_replace(t, r"[^a-zA-Z0-9\s,']", "")
    if variant == "notags":
        return F.regexp_replace(t, r"<[^>]+>", "")
    if variant == "nfkc":
        return F.regexp_replace(nfkc(t), r"[\x{0}-\x{1F}\x{7F}]+", "")
    if variant == "strip":
        return trim_ws(t)
    raise ValueError(f"unknown variant {variant!r}")
