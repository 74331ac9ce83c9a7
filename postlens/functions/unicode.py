"""Arrow-batched Python helpers for the few text steps Spark has no native function for:
Unicode NFKC normalisation, emoji-to-words, and HTML text extraction.

Each is a small per-value helper wrapped in an ``arrow_udf`` (one Arrow batch per call), which makes Python
strings of ``SLICE`` values at a time only: a batch of long pages is never held as Python strings.  All
surrounding steps stay JVM-side.  Filters should run before these so fewer rows cross to Python.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Values of a batch that are Python strings at a time.
SLICE = 64


def _in_slices(helper: Callable[[str | None], str | None], values: pa.Array) -> pa.Array:
    parts = [pa.array(map(helper, values.slice(k, SLICE).to_pylist()), pa.string()) for k in range(0, len(values), SLICE)]
    return pa.concat_arrays(parts) if parts else pa.array([], pa.string())


def _nfkc(s: str | None) -> str | None:
    if s is None or s.isascii() or unicodedata.is_normalized("NFKC", s):
        return s
    return unicodedata.normalize("NFKC", s)


@F.arrow_udf(T.StringType())
def _nfkc_udf(s: pa.Array) -> pa.Array:
    return _in_slices(_nfkc, s)


def nfkc(c) -> Column:
    """Unicode NFKC.  ASCII texts stay as they are on the JVM side; the helper sees a null in their place,
    so the argument, a plain column as a rule, is named more than once."""
    col = F.col(c) if isinstance(c, str) else c
    other = col.rlike(r"[^\x00-\x7F]")
    return F.when(other, _nfkc_udf(F.when(other, col))).otherwise(col)


# The characters that width folding changes and NFKC leaves (curly quotes, minus sign, wave
# dash), and what they become.
_WIDE, _NARROW = "\u201d\u2019\u2018\u2212\u301c", "\"'`-~"


def fold_width(c) -> Column:
    """NFKC, then the rest of the folding of full-width letters, digits and marks to ASCII."""
    return F.translate(nfkc(c), _WIDE, _NARROW)


# Emoji ranges treated as emoji when the character is a symbol (category So/Sk).
_EMOJI_RANGES = ((0x1F000, 0x1FAFF), (0x2600, 0x27BF), (0x2300, 0x23FF), (0x2B00, 0x2BFF),
                 (0x3030, 0x3030), (0x303D, 0x303D), (0x3297, 0x3299), (0x00A9, 0x00AE),
                 (0x2190, 0x21FF), (0x2100, 0x214F))
_MARKS = "\ufe0e\ufe0f"
# The five skin tones, lightest first.
_TONES = ("light_skin_tone", "medium_light_skin_tone", "medium_skin_tone", "medium_dark_skin_tone", "dark_skin_tone")

_ONE = "[" + "".join(f"\\U{lo:08x}-\\U{hi:08x}" for lo, hi in _EMOJI_RANGES) + "]"
_PART = f"{_ONE}[\U0001f3fb-\U0001f3ff]?[{_MARKS}]?"
#: A flag of two letters, a keycap, or emoji joined to one.
_SEQUENCE = re.compile(f"[\U0001f1e6-\U0001f1ff]{{2}}|[0-9#*]\ufe0f?\u20e3|{_PART}(?:\u200d{_PART})*|[{_MARKS}\u200d\u20e3\U0001f3fb-\U0001f3ff]")


def _emoji_name(sequence: str) -> str | None:
    """Words for one emoji: ``flag_id``, ``keycap_1``, or the Unicode names of its parts, skin tones after
    theirs, in snake case; an empty string for stray joiners and marks, None for what is no emoji."""
    if "\U0001f1e6" <= sequence[0] <= "\U0001f1ff" and len(sequence) == 2:
        return "flag_" + "".join(chr(ord(c) - 0x1F1E6 + 97) for c in sequence)
    if sequence[-1] == "\u20e3" and len(sequence) > 1:
        return "keycap_" + {"#": "number_sign", "*": "asterisk"}.get(sequence[0], sequence[0])
    words = []
    for ch in sequence:
        if "\U0001f3fb" <= ch <= "\U0001f3ff":
            words += [_TONES[ord(ch) - 0x1F3FB]] if words else []
        elif ch not in _MARKS + "\u200d\u20e3":
            name = unicodedata.name(ch, "") if unicodedata.category(ch) in ("So", "Sk", "Sm") else ""
            if not name:
                return None
            words.append(name.lower().replace(" ", "_").replace("-", "_"))
    return "_".join(words)


def _demojize(s: str | None, left: str = " ", right: str = " ") -> str | None:
    """Each emoji, whole sequences as one, becomes its name between delimiters."""
    if s is None or s.isascii():
        return s

    def name(m: re.Match) -> str:
        found = _emoji_name(m[0])
        return m[0] if found is None else left + found + right if found else ""
    return _SEQUENCE.sub(name, s)


@F.arrow_udf(T.StringType())
def demojize_udf(s: pa.Array) -> pa.Array:
    return _in_slices(_demojize, s)


def demojize(c) -> Column:
    """Emoji → their names in words.  The argument, a long chain as a rule, is named once."""
    return demojize_udf(F.col(c) if isinstance(c, str) else c)


class _TextCollector(HTMLParser):
    """Visible text of a page: every text node except inside script/style/template; comments
    dropped; character references decoded."""

    _SKIP = {"script", "style", "template"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.depth = 0

    def handle_starttag(self, tag, attrs):
        if tag in self._SKIP:
            self.depth += 1

    def handle_endtag(self, tag):
        if tag in self._SKIP and self.depth:
            self.depth -= 1

    def handle_data(self, data):
        if not self.depth:
            self.parts.append(data)


def _get_text(html: str | None) -> str | None:
    if html is None:
        return None
    p = _TextCollector()
    p.feed(html)
    p.close()
    return "".join(p.parts)


@F.arrow_udf(T.StringType())
def html_get_text(s: pa.Array) -> pa.Array:
    return _in_slices(_get_text, s)
