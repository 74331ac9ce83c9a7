"""Rule labelling.

The reference hands layered keyword rules to a language model.  Here the rules are data — an
ordered list of ``Rule`` rows — compiled into one ``CASE WHEN`` chain: the first matching rule
labels the row.  Phrases match whole words on the lower-cased text.  ``label_with`` runs any
external labeller callable over Arrow batches and parses its responses (C22).
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postlens.functions import text as TX
from postlens.functions.parse import SENTIMENT_SCHEMA, parse_label_response


@dataclass(frozen=True)
class Rule:
    """A rule fires when: the text contains one phrase of every group in ``all_of`` (the text
    without hashtags when ``text_only``), none of ``none_of``, one of ``tags`` (when given), and —
    with ``hashtag_only`` — nothing but hashtags."""
    name: str
    label: object
    confidence: float = 1.0
    reason: str = ""
    all_of: tuple[tuple[str, ...], ...] = ()
    none_of: tuple[str, ...] = ()
    tags: tuple[str, ...] = ()
    text_only: bool = False
    hashtag_only: bool = False


@dataclass(frozen=True)
class RuleSet:
    rules: tuple[Rule, ...]
    default_label: object = None
    default_confidence: float | None = None
    default_reason: str = "no rule matched"
    label_type: str = "boolean"


NONWORD = r"[^\p{L}\p{N}_]+"


def padded_words(c: Column) -> Column:
    """Lower-cased text with every run of non-word characters turned into one space, padded
    with a space on both sides: a phrase matches as whole words by a plain substring test."""
    return F.concat(F.lit(" "), F.regexp_replace(F.lower(c), NONWORD, " "), F.lit(" "))


def phrase_key(phrase: str) -> str:
    """The padded form of a phrase (words separated by single spaces)."""
    return " " + " ".join(w for w in re.split(r"[^\w]+", phrase.lower()) if w) + " "


def _any_phrase(target: Column, phrases) -> Column:
    cond = F.lit(False)
    for p in phrases:
        cond = cond | target.contains(phrase_key(p))
    return cond


def _matches(rule: Rule, text: Column, bare: Column, tags: Column, bare_len: Column) -> Column:
    cond = F.lit(True)
    target = bare if rule.text_only else text
    for group in rule.all_of:
        cond = cond & _any_phrase(target, group)
    if rule.none_of:
        cond = cond & ~_any_phrase(target, rule.none_of)
    if rule.tags:
        cond = cond & F.arrays_overlap(tags, F.array(*[F.lit(t.lower()) for t in rule.tags]))
    if rule.hashtag_only:
        cond = cond & (bare_len == 0) & (F.size(tags) > 0)
    return cond


def rule_label(df: DataFrame, rules: RuleSet, col: str = "content") -> DataFrame:
    """Adds ``label``, ``confidence``, ``reason`` and ``rule`` (the first matching rule).
    Phrases match whole words, insensitive to case, punctuation and repeated spaces between
    words; ``text_only`` rules look at the text without hashtags."""
    low = F.lower(F.col(col))
    bare = TX.remove_hashtags(low)
    x = (df.withColumn("_t", padded_words(low)).withColumn("_b", padded_words(bare))
         .withColumn("_bl", F.length(bare)).withColumn("_h", TX.extract_hashtags(low)))
    t, b, h, bl = F.col("_t"), F.col("_b"), F.col("_h"), F.col("_bl")
    number = F.lit(len(rules.rules) + 1)                       # every condition once: the first rule's number
    for k in range(len(rules.rules), 0, -1):
        number = F.when(_matches(rules.rules[k - 1], t, b, h, bl), F.lit(k)).otherwise(number)
    last = (rules.default_label, rules.default_confidence, rules.default_reason, "default")
    outcome = F.array(*[F.struct(F.lit(label).cast(rules.label_type).alias("label"), F.lit(conf).cast("double").alias("confidence"),
                                 F.lit(reason).alias("reason"), F.lit(name).alias("rule"))
                        for label, conf, reason, name in [*((r.label, r.confidence, r.reason, r.name) for r in rules.rules), last]])
    x = x.withColumn("_r", F.element_at(outcome, number))
    return (x.withColumn("label", F.col("_r.label")).withColumn("confidence", F.col("_r.confidence"))
            .withColumn("reason", F.col("_r.reason")).withColumn("rule", F.col("_r.rule")).drop("_t", "_b", "_bl", "_h", "_r"))


# ---------------------------------------------------------------- fixed rule data of the study

# The relevance layers (spam, core bill/concepts/actors, package bills with tags,
# general institution mentions, opinion words) and the relevant hashtags.
SPAM = ("giveaway", "ga", "raffle", "jualan", "olshop", "jual", "wts", "jastip", "promo", "diskon",
        "murah", "cek bio", "link di bio", "klik bio", "linkonbio", "cek pinned", "kak", "join",
        "ikut", "ikutan", "wish me luck", "wml", "bismillah win")
CORE_BILL = ("ruu tni", "revisi uu tni", "revisi uu 34 2004", "uu tni", "ruu tentara nasional indonesia")
CORE_CONCEPTS = ("dwifungsi abri", "dwifungsi tni", "jabatan sipil", "perluasan jabatan sipil", "omsp",
                 "operasi militer selain perang", "tni berpolitik", "militer masuk politik",
                 "peradilan militer", "impunitas", "kemunduran reformasi", "ancaman demokrasi")
CORE_ACTORS = ("imparsial", "kontras", "komnas ham", "koalisi sipil", "koalisi masyarakat sipil")
PACKAGE = ("ruu polri", "revisi uu polri", "ruu kejaksaan", "polisi superbody")
RELEVANT_TAGS = ("#tolakruutni", "#ruutni", "#dwifungsiabri", "#tolakdwifungsiabri",
                 "#kembalikantnipromiliter", "#saveourdemocracy", "#tolakrevisiuutni", "#tolakuutni",
                 "#tolakruupolri", "#indonesiagelap", "#tolakruukejaksaan")
GENERAL = ("dirgahayu tni", "hut tni", "tni hebat", "prajurit", "amankan perbatasan",
           "tni bantu rakyat", "tni jaya selalu")
OPINION = ("ngeri banget", "setuju", "tolak", "parah", "enggak ada hati nuraninya", "gila")

RELEVANCE_RULES = RuleSet(rules=(
    Rule("layer0_spam", False, 1.0, "Advertising or reply bait.", all_of=(SPAM,)),
    Rule("layer1_core", True, 1.0, "Explicitly mentions the bill or its core concepts.",
         all_of=(CORE_BILL + CORE_CONCEPTS + CORE_ACTORS,), text_only=True),
    Rule("layer2_package", True, 1.0, "Related package bill within the protest context.",
         all_of=(PACKAGE,), tags=RELEVANT_TAGS),
    Rule("layer3_general", False, 1.0, "General mention of the institution.",
         all_of=(GENERAL,), text_only=True),
    Rule("layer4a_opinion", True, 0.9, "Relevant hashtag matches opinion in text.",
         all_of=(OPINION,), tags=RELEVANT_TAGS, text_only=True),
    Rule("layer4b_hashtag_only", True, 0.5, "Hashtag-only post with relevant hashtags.",
         tags=RELEVANT_TAGS, hashtag_only=True),
    Rule("layer4c_mismatch", False, 1.0, "Context-hashtag mismatch.", tags=RELEVANT_TAGS),
), default_label=False, default_confidence=1.0, label_type="boolean")

# Sentiment gates (news, other-entity-only, bundle, cue words).
NEWS = ("dpr sahkan", "poin-poin revisi", "demo terjadi")
MILITARY = ("tni", "militer", "dwifungsi")
POLICE = ("polri", "polisi", "parcok", "wereng")
OTHER_BODIES = ("ruu kejaksaan", "kejaksaan", "kuhp", "mahkamah konstitusi", "mk")
OPPOSE_CUES = ("mulyono", "indonesia gelap", "peringatan darurat", "selamat datang orba")
NEUTRAL_CUES = ("titip sandal",)

SENTIMENT_RULES = RuleSet(rules=(
    Rule("gate1_news", 1, 1.0, "Factual news or announcement.", all_of=(NEWS,)),
    Rule("gate2a_police_only", 1, 1.0, "Targets only the police.", all_of=(POLICE,), none_of=MILITARY),
    Rule("gate2b_other_only", 1, 1.0, "Targets only other bodies.", all_of=(OTHER_BODIES,), none_of=MILITARY),
    Rule("gate2c_bundle", 0, 1.0, "Attacks the bundle including the military.",
         all_of=(MILITARY, POLICE + OTHER_BODIES)),
    Rule("gate3_oppose_cue", 0, 1.0, "Opposition cue word.", all_of=(OPPOSE_CUES,)),
    Rule("gate3_neutral_cue", 1, 1.0, "Thread-following cue.", all_of=(NEUTRAL_CUES,)),
), default_label=1, default_confidence=None, label_type="int")


# ---------------------------------------------------------------- H13: external labeller

def label_with(df: DataFrame, labeller: Callable[[str], str], col: str = "content",
               schema: T.StructType = SENTIMENT_SCHEMA, default=1, target: str | None = None,
               id_col: str = "tweet_id") -> DataFrame:
    """Call ``labeller(text) -> response text`` for every row inside Arrow batches
    (``spark.sql.execution.arrow.maxRecordsPerBatch`` sets the batch size), then parse the
    responses (C22); failures keep ``default`` and record an error."""
    out_schema = T.StructType([df.schema[id_col], T.StructField("response", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            resp = []
            for t in b[col]:
                try:
                    resp.append(labeller(t) if t is not None else None)
                except Exception as e:  # a failing call keeps the default
                    resp.append(json.dumps({"error": str(e)}))
            yield pd.DataFrame({id_col: b[id_col], "response": resp})

    raw = df.select(id_col, col).mapInPandas(run, out_schema)
    parsed = parse_label_response(F.col("response"), schema, default, target)
    return raw.select(id_col, "response", parsed["value"].alias("label"), parsed["error"].alias("error"))

