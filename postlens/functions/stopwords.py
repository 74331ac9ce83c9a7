"""Stop-word lists.

The keyword study combines several published lists with a slang set.  The published lists are
parameters: ``load_stopwords(path)`` reads any whitespace-separated word file (one per line),
so the full Indonesian lists can be supplied from a shared location.  The built-in defaults are
the slang set of the study, the common English list, and a core Indonesian function-word list.
"""

from __future__ import annotations

# Colloquial Indonesian slang stop words of the keyword study.
SLANG = frozenset("""
ga gak nggak ngga aja nih dong deh lah loh kok kan nya ya emang tau yg pd trs pls plis thx makasih
makasi terimakasih bgt bngt bener btw rt dm gw gue lu loe lo gua ny jd jadi sih kayak kek oke ok
bro sis min kalo kalau dgn dengan bikin
""".split())

# The common English stop-word list (179 words).
ENGLISH = frozenset("""
i me my myself we our ours ourselves you you're you've you'll you'd your yours yourself yourselves
he him his himself she she's her hers herself it it's its itself they them their theirs themselves
what which who whom this that that'll these those am is are was were be been being have has had
having do does did doing a an the and but if or because as until while of at by for with about
against between into through during before after above below to from up down in out on off over
under again further then once here there when where why how all any both each few more most other
some such no nor not only own same so than too very s t can will just don don't should should've
now d ll m o re ve y ain aren aren't couldn couldn't didn didn't doesn doesn't hadn hadn't hasn
hasn't haven haven't isn isn't ma mightn mightn't mustn mustn't needn needn't shan shan't shouldn
shouldn't wasn wasn't weren weren't won won't wouldn wouldn't
""".split())

# Core Indonesian function words.
INDONESIAN = frozenset("""
ada adalah agar akan aku anda apa atau bagi bahwa banyak belum beberapa begitu bisa boleh bukan
dalam dan dari dia hal hanya harus ini itu jika juga kami kamu karena ke kepada ketika kita lagi
lain maka mana masih mereka oleh pada para pun saat saja sama sampai sangat saya sebagai sebelum
sedang sejak sekali semua seperti serta setelah sudah supaya tak tapi telah tentang tersebut tetapi
tidak untuk yang
""".split())

DEFAULT_STOPWORDS = frozenset(w.lower() for w in SLANG | ENGLISH | INDONESIAN)


def load_stopwords(*paths: str, include_default: bool = True) -> frozenset[str]:
    words = set(DEFAULT_STOPWORDS) if include_default else set()
    for p in paths:
        with open(p, encoding="utf-8") as f:
            words.update(w.lower() for w in f.read().split())
    return frozenset(words)


def sql_list(words) -> str:
    """The words as a SQL literal list (for the oracle queries)."""
    return ", ".join("'" + w.replace("'", "''") + "'" for w in sorted(words))
